"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written to the
shared folder as Parquet and read again as the next stage's ``docs``. The last returns
packed pieces, all others whole rows of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coldwatch.llm.common import stored, table
from coldwatch.llm.stages import (
    drop_benchmark_passages,
    keep_known_languages,
    keep_one_of_each_group,
    keep_quality,
    pack_sequences,
)

STAGES = [
    ("language_id", keep_known_languages),
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

# Models, fingerprints and tokenizers are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
