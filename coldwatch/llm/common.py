"""What the operators share: reading tables, tables in the shared folder, text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies at the same path as here.

    Elsewhere ship it with ``--py-files``.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that all executors share.

    Taken from ``spark.checkpoint.dir``; a local session may do without.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="coldwatch-llm-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage, survives lost executors, is computed once however often it
    is read, and tells the planner its size.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``text``, null texts as empty ones."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def extended(docs: DataFrame, carried: list[str], added: str) -> StructType:
    """The fields ``carried`` of ``docs`` and those ``added``."""
    return StructType([docs.schema[n] for n in carried] + StructType.fromDDL(added).fields)


def as_rows(docs: DataFrame) -> DataFrame:
    """``text`` and the whole row as ``row``, so that no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def crc_remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def portions(source: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what is made of one slice stays small."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def lists(flat: np.ndarray, sizes: Iterable[int], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of consecutive runs of ``flat``."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def batches(schema: pa.Schema, columns: dict, rows: int = 8192) -> Iterable[pa.RecordBatch]:
    """Columns as record batches of a bounded number of rows."""
    whole = pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    yield from whole.to_batches(max_chunksize=rows)
