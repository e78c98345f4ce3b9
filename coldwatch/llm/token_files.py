"""Token files: Parquet with one row per document and its ids as a list.

A file holds documents in ascending ``doc_id`` order. Ids are dictionary-coded
(a vocabulary fits one dictionary page, so an id takes its bit width); ``doc_id``
and ``start`` ascend and ``n_tokens`` is small, so these are delta-coded. Row groups are of bounded
size, pages of bounded rows, and pages are indexed, so a range of documents reads
only its pages, and metadata reads touch no ids.

Null texts count as empty, so such a document is the end id alone. Rows that repeat
a ``doc_id`` are all kept, ordered by text; a null ``doc_id`` comes first. Other
columns are ignored. An empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldwatch.llm.common import extended, lists, portions, ready, with_text
from coldwatch.llm.wordpieces import default_path, documents_ids

FILE_SCHEMA = "part int, doc_id long, start long, n_tokens long, tokens array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
DOCUMENTS_AT_ONCE = 1024

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#part": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _token_rows(tokenizer: str, end_id: int):
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
         ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))]
    )

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in portions(source, DOCUMENTS_AT_ONCE):
            ids, sizes = documents_ids(tokenizer, batch.column("text"), end_id)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(sizes), part, np.int32)), batch.column("doc_id"),
                 pa.array(starts), pa.array(sizes),
                 lists(ids.view(np.int32), sizes, pa.int32())],
                schema=schema,
            )

    return rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Writes ``docs`` (doc_id, text) as token files under ``path``.

    ``path/tokens`` has the documents, with ``start`` counted within their part;
    ``path/index`` has a row per part: its first document and the ids before it.
    """
    spark = ready(docs.sparkSession)
    ordered = (
        with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    tokens = ordered.mapInArrow(_token_rows(tokenizer or default_path(), end_id), FILE_SCHEMA)
    tokens.write.options(**WRITER).parquet(f"{path}/tokens")
    parts = (
        read_metadata(spark, path)
        .groupBy("part")
        .agg(F.min("doc_id").alias("first_doc_id"), F.sum("n_tokens").alias("n_tokens"))
    )
    # One row per part, so the number of tasks bounds it. Parts ascend with doc_id.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = parts.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    index.write.parquet(f"{path}/index")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start within the part, n_tokens; no ids are read."""
    return read_tokens(spark, path).drop("tokens")


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """The documents of the files; bounds on ``doc_id`` prune row groups and pages."""
    docs = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/tokens")
    if first is not None:
        docs = docs.where(F.col("doc_id") >= first)
    if last is not None:
        docs = docs.where(F.col("doc_id") <= last)
    return docs


def with_global_start(docs: DataFrame, path: str) -> DataFrame:
    """``start`` counted over all parts in ``doc_id`` order."""
    index = docs.sparkSession.read.parquet(f"{path}/index").select("part", "before")
    return (
        docs.join(index, "part")
        .withColumn("start", F.col("start") + F.col("before"))
        .drop("before")
    )


def ids_digest(column: pa.ListArray) -> pa.Array:
    """Unsigned CRC-32 of each list's ids as little-endian 32-bit integers."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    data = memoryview(np.ascontiguousarray(flat)).cast("B")
    return pa.array(
        [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64()
    )


def with_digest(rows: DataFrame, ids: str) -> DataFrame:
    """Replaces the list column ``ids`` by ``ids_crc32``."""
    ready(rows.sparkSession)
    names = [n for n in rows.columns if n != ids]

    def digest(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            columns = [batch.column(n) for n in names] + [ids_digest(batch.column(ids))]
            yield pa.record_batch(columns, names=[*names, "ids_crc32"])

    return rows.select(*names, ids).mapInArrow(digest, extended(rows, names, "ids_crc32 long"))
