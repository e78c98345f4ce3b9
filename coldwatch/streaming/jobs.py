"""Streaming jobs: the alert stream, the fleet view and the counters.

Each job takes a streaming DataFrame and a folder. Results and checkpoint live
under that folder, so a job that is started again goes on where it stopped and
counts nothing twice: a micro-batch that is retried replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coldwatch.operators.fleet import (
    DEFAULT_MAX_AGE_SECONDS,
    fleet_state,
    latest_per_truck,
    wire_messages,
)
from coldwatch.operators.intervals import alert_intervals
from coldwatch.operators.metrics import count_messages, metrics_table
from coldwatch.sources.wire import decode
from coldwatch.streaming.versions import SNAPSHOT_EVERY, VersionedTables, newest_by


def _start(writer, folder: str, trigger: dict | None) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


# --- alerts ------------------------------------------------------------------


def start_alerts(
    alerts: DataFrame, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Appends a stream of alerts (``alerts_primary``) to a table, each exactly once."""
    writer = (
        alerts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/table")
    )
    return _start(writer, folder, trigger)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/table")


# --- fleet state -------------------------------------------------------------


def start_fleet_state(
    latest: DataFrame,
    folder: str,
    trigger: dict | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Keeps a table of ``latest_per_truck`` up to date; trucks are never evicted.

    A micro-batch writes only the trucks that changed. Every so often the whole
    table is written too, so that a reader needs one snapshot and the few
    batches after it.
    """
    tables = _fleet_tables(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.commit(batch_id, {"fleet": batch}, snapshot_every)

    return _start(latest.writeStream.outputMode("update").foreachBatch(write), folder, trigger)


def _fleet_tables(folder: str) -> VersionedTables:
    return VersionedTables(folder, {"fleet": newest_by("truck_id")})


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The fleet table in the shape of ``latest_per_truck``, as of the last finished batch."""
    return _fleet_tables(folder).read(spark, "fleet")


def read_fleet_state(
    spark: SparkSession,
    folder: str,
    as_of: Column | None = None,
    max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS,
) -> DataFrame:
    """Expiry is judged when the table is read, against ``as_of``."""
    return fleet_state(read_latest(spark, folder), as_of, max_age_seconds)


# --- expiry ------------------------------------------------------------------


def start_alert_intervals(
    alerts: DataFrame,
    folder: str,
    trigger: dict | None = None,
    max_age_seconds: int = DEFAULT_MAX_AGE_SECONDS,
    late: str = "0 seconds",
) -> StreamingQuery:
    """Appends the active interval of a truck to a table when it is over (``alert_intervals``).

    The state is one session per truck that has an active alert; it is dropped at its end.
    """
    over = alert_intervals(alerts, max_age_seconds, late)
    writer = over.writeStream.outputMode("append").format("parquet")
    return _start(writer.option("path", f"{folder}/table"), folder, trigger)


def read_alert_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/table")


# --- counters ----------------------------------------------------------------


def start_metrics(
    counts: DataFrame, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keeps the counts of ``count_messages`` since the job was first started.

    A micro-batch writes all of them: a few rows, one per kind of message, in one file.
    """
    tables = _counter_tables(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.commit(batch_id, {"counts": batch.repartition(1)})

    return _start(counts.writeStream.outputMode("complete").foreachBatch(write), folder, trigger)


def _counter_tables(folder: str) -> VersionedTables:
    return VersionedTables(folder, {"counts": None})


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All series as of the last finished batch."""
    return metrics_table(_counter_tables(folder).read(spark, "counts"))


# --- both topics as JSON ---------------------------------------------------------


def start_fleet_state_from_wire(
    messages: DataFrame, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """``start_fleet_state`` over JSON messages of both topics (topic, event_id, value)."""
    return start_fleet_state(latest_per_truck(wire_messages(decode(messages))), folder, trigger)


def start_metrics_from_wire(
    messages: DataFrame, folder: str, trigger: dict | None = None
) -> StreamingQuery:
    """``start_metrics`` over JSON messages of both topics, with those that cannot be used."""
    feed = decode(messages).select(
        "topic", "document.alert_type", "document.severity", "counted", "failed"
    )
    return start_metrics(count_messages(feed), folder, trigger)
