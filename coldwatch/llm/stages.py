"""The stages of the corpus pipeline; each works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldwatch.llm import decontaminate, language, packing, quality, simhash
from coldwatch.llm.common import as_rows, stored, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects; fitted on the labels of ``docs``.

    Null texts and texts without a letter are rejected. Repeated rows and null ids are judged
    by their texts, and stay or go together. An empty table stays empty.
    """
    model = language.fit(language.learnt_from(docs))
    return language.identify(as_rows(docs), model, "row").where("not rejected").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted to be of low quality; fitted on the table ``labels``.

    Null and empty texts are scored like any other, as texts without words. Repeated rows and
    null ids are judged by their texts, and stay or go together. An empty table stays empty.
    """
    model = quality.fit(docs, quality.learnt_from(table(spark, sf_dir, "labels")))
    return quality.score(as_rows(docs), model, "row").where("predicted = 1").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one document, that with the smallest id.

    If that id has several texts in the group, the one with the smallest hash stays; of rows
    that repeat both id and text one stays, whichever their other columns are, the same in
    every run. An id may stay with texts of several groups. Documents without an id
    cannot be named by a group and stay.
    """
    found = simhash.components_of(docs).where("doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    kept = stored(first.select("kept.*"), "kept").withColumnsRenamed(
        {"doc_id": "kept_id", "text_hash": "kept_text"}
    )
    row_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit(""))
    same = (row_id == kept["kept_id"]) & (F.xxhash64(text) == kept["kept_text"])
    named = docs.join(kept, same, "left_semi")
    own = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(
        F.xxhash64(*[f"`{c}`" for c in docs.columns])
    )
    # The row travels as one column, so that no name of its columns can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    numbered = named.select(whole, F.row_number().over(own).alias("place"))
    return numbered.where("place = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``.

    Null and empty texts hold none and stay, and so does every repeated row that is clean.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, sequence and place; see ``packing.pack``.

    Null and empty texts give a piece with the end id alone; repeated rows are packed each.
    """
    return packing.pack(docs)
