"""The operators applied to their whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm import (
    decontaminate,
    language,
    licenses,
    lshforest,
    neighbours,
    packing,
    pages,
    quality,
    simhash,
    sql,
    token_files,
    tools,
    trie,
    whitening,
)
from coldwatch.llm.common import crc_remainder, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.learnt_from(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, model, "doc_id")
    held_out = crc_remainder("doc_id", 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    rows = token_files.with_digest(token_files.read_tokens(spark, path), "tokens")
    rows = token_files.with_global_start(rows, path)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.learnt_from(docs))
    found = language.identify(docs, model, "doc_id")
    held_out = crc_remainder("doc_id", 4) == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tools.calls_of(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(
        tools.SCHEMAS, "name string, argument string, type string, required boolean"
    )
    return tools.link(calls, results, schemas)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.with_digest(packing.pack(table(spark, sf_dir, "documents")), "ids")
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_nearest": op2_nearest,
        "op3_quality": op3_quality,
        "op4_token_files": op4_token_files,
        "op5_licenses": op5_licenses,
        "op6_language": op6_language,
        "op7_tool_calls": op7_tool_calls,
        "op8_simhash": op8_simhash,
        "op9_pages": op9_pages,
        "op10_packing": op10_packing,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_nearest": sql.NEAREST,
        "op5_licenses": sql.licenses(),
        "op7_tool_calls": sql.TOOL_CALLS,
        "op12_prefix_trie": sql.PREFIX_TRIE,
        "op13_minhash": sql.MINHASH,
    }
