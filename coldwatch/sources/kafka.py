"""Kafka ends of the streaming jobs.

These only set options: the connector is not part of a plain PySpark install
(add spark-sql-kafka-0-10 to the session). Messages keep Kafka's own columns;
``offset`` doubles as the sequence number, since a truck is the message key and
so has all its messages of a topic in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from coldwatch.schemas import TOPICS


def read_topics(
    spark: SparkSession,
    servers: str,
    topics: Sequence[str] = tuple(TOPICS),
    starting_offsets: str = "latest",
    **options: str,
) -> DataFrame:
    """Stream of ``topic, partition, offset, timestamp, key, value, event_id``."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting_offsets)
    )
    return as_messages(reader.options(**options).load())


def as_messages(records: DataFrame) -> DataFrame:
    """Kafka records with text key and value and a sequence number."""
    return records.selectExpr(
        "topic",
        "partition",
        "offset",
        "timestamp AS kafka_timestamp",
        "CAST(key AS STRING) AS key",
        "CAST(value AS STRING) AS value",
        "offset AS event_id",
    )


def write_topic(
    messages: DataFrame, servers: str, topic: str, checkpoint: str, **options: str
) -> DataStreamWriter:
    """Append ``key, value`` messages to a topic, keyed so a truck stays in order."""
    return (
        messages.select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .options(**options)
        .outputMode("append")
    )
