"""Schema validation: readings that have every field, and the others with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.schemas import TELEMETRY_FIELDS

PROBLEMS = "missing_fields"


def _table_column(name: str) -> str:
    return "ts" if name == "timestamp" else name


def _complete() -> Column:
    condition = F.lit(True)
    for name, _ in TELEMETRY_FIELDS:
        condition = condition & F.col(_table_column(name)).isNotNull()
    return condition


def missing_fields() -> Column:
    """Names of required fields a reading lacks, in schema order."""
    names = [
        F.when(F.col(_table_column(name)).isNull(), F.lit(name)) for name, _ in TELEMETRY_FIELDS
    ]
    return F.array_compact(F.array(*names))


def telemetry_valid(telemetry: DataFrame) -> DataFrame:
    """Readings with all twenty fields. Enumerated texts are not checked."""
    return telemetry.where(_complete())


def telemetry_invalid(telemetry: DataFrame) -> DataFrame:
    """The other readings, with the fields they lack."""
    return telemetry.where(~_complete()).withColumn(PROBLEMS, missing_fields())
