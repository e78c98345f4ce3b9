"""One consumer of both topics: fleet, counters, history, feed and dead letters.

A micro-batch is decoded once. What the batch alone says of each table is written as a part
that can be merged with the parts before, so no table is read to be brought up to date,
a batch costs what it holds, and a retried batch counts once. All tables are versions of
one manifest, so a reader that pins it sees them at the same message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coldwatch.functions.time import parse_utc
from coldwatch.operators.feed import FEED_FIELDS
from coldwatch.operators.fleet import (
    DEFAULT_MAX_AGE_SECONDS,
    fleet_state,
    latest_of_parts,
    merge_latest,
    partial_latest,
    wire_messages,
)
from coldwatch.operators.history import alert_history
from coldwatch.operators.metrics import count_messages, merge_counts, metrics_table
from coldwatch.schemas import ALERTS_TOPIC, PRIMARY_ALERT_FIELDS
from coldwatch.sources.wire import alerts_from_wire, decode, decode_errors
from coldwatch.streaming.versions import SNAPSHOT_EVERY, Version, VersionedTables

FLEET, COUNTERS, HISTORY = "fleet", "counters", "history"
FEED, DEAD_LETTERS = "feed", "dead_letters"


def consumer_tables(folder: str) -> VersionedTables:
    merges = {FLEET: merge_latest, COUNTERS: merge_counts, HISTORY: _merge_history}
    return VersionedTables(folder, merges, (FEED, DEAD_LETTERS))


def _merge_history(parts: DataFrame) -> DataFrame:
    """The newest of the newest: a bounded top-k stays one however it is put together."""
    return alert_history(parts)


def _feed(decoded: DataFrame) -> DataFrame:
    """Usable messages of both topics; a field a topic does not have is null."""
    documents = F.when(F.col("document").isNotNull(), F.array("document"))
    fields = decoded.select("topic", "event_id", F.inline(documents))
    return fields.withColumn("timestamp", parse_utc(F.col("timestamp"))).select(*FEED_FIELDS)


def parts_of(decoded: DataFrame) -> dict[str, DataFrame]:
    """What decoded messages (``wire.decode``) add to each table and log."""
    kinds = decoded.select(
        "topic", "document.alert_type", "document.severity", "counted", "failed"
    )
    alerts = alerts_from_wire(decoded.where(F.col("topic") == ALERTS_TOPIC))
    return {
        FLEET: partial_latest(wire_messages(decoded)),
        COUNTERS: count_messages(kinds),
        HISTORY: alert_history(alerts.select("event_id", *PRIMARY_ALERT_FIELDS)),
        FEED: _feed(decoded),
        DEAD_LETTERS: decode_errors(decoded).drop("document"),
    }


def start_consumer(
    messages: DataFrame,
    folder: str,
    trigger: dict | None = None,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Consumes JSON messages of both topics (topic, event_id, value) into the tables."""
    tables = consumer_tables(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            tables.commit(batch_id, parts_of(batch), snapshot_every)
        finally:
            batch.unpersist()

    writer = decode(messages).writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    """The fleet in the shape of ``latest_per_truck``."""
    return latest_of_parts(consumer_tables(folder).read(spark, FLEET, version))


def read_fleet_state(
    spark: SparkSession,
    folder: str,
    as_of: Column | None = None,
    max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS,
    version: Version | None = None,
) -> DataFrame:
    """Expiry is judged when the table is read, against ``as_of``."""
    return fleet_state(read_latest(spark, folder, version), as_of, max_age_seconds)


def read_metrics(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    return metrics_table(consumer_tables(folder).read(spark, COUNTERS, version))


def read_history(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    """The newest alerts so far, for ``alerts_recent`` and ``truck_recent_alerts``."""
    return consumer_tables(folder).read(spark, HISTORY, version)


def read_feed(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    return consumer_tables(folder).read_log(spark, FEED, version)


def read_dead_letters(
    spark: SparkSession, folder: str, version: Version | None = None
) -> DataFrame:
    """The messages that could not be used, with the reason."""
    return consumer_tables(folder).read_log(spark, DEAD_LETTERS, version)
