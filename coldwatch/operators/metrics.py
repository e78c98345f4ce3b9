"""Counters over the feed: messages, topics, alert types, severities, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.operators.alerts import UNKNOWN
from coldwatch.schemas import ALERTS_TOPIC, TOPICS

# Series names.
MESSAGES_TOTAL = "logistics_messages_total"
MESSAGES_BY_TOPIC = "logistics_messages_by_topic"
ALERTS_BY_TYPE = "logistics_alerts_by_type"
ALERTS_BY_SEVERITY = "logistics_alerts_by_severity"
ERRORS_TOTAL = "logistics_errors_total"


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(UNKNOWN))


def messages_by_topic(feed: DataFrame) -> DataFrame:
    """Messages per topic; the known topics are listed even with none."""
    known = F.array(*[F.lit(topic) for topic in TOPICS])
    zeros = feed.sparkSession.range(1, numPartitions=1).select(
        F.explode(known).alias("topic"), F.lit(0).cast("bigint").alias("messages")
    )
    counted = feed.groupBy("topic").agg(F.count("*").alias("messages"))
    return (
        counted.unionByName(zeros).groupBy("topic").agg(F.sum("messages").alias("messages"))
    )


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(_or_unknown("alert_type").alias("alert_type")).agg(
        F.count("*").alias("alerts")
    )


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(_or_unknown("severity").alias("severity")).agg(
        F.count("*").alias("alerts")
    )


def count_messages(feed: DataFrame) -> DataFrame:
    """The feed reduced to its few distinct (topic, type, severity) combinations.

    ``feed`` has ``topic``, ``alert_type``, ``severity`` and may have ``counted``
    (the message was readable) and ``failed`` (it could not be processed).
    """
    counted = F.col("counted") if "counted" in feed.columns else F.lit(True)
    failed = F.col("failed") if "failed" in feed.columns else F.lit(False)
    return feed.groupBy(
        "topic",
        F.when(F.col("topic") == ALERTS_TOPIC, _or_unknown("alert_type")).alias("alert_type"),
        F.when(F.col("topic") == ALERTS_TOPIC, _or_unknown("severity")).alias("severity"),
    ).agg(
        F.count_if(counted).alias("messages"),
        F.count_if(failed).alias("errors"),
        # An unusable message on the alert topic reaches no alert counter.
        F.count_if(counted & ~failed).alias("usable"),
    )


def merge_counts(parts: DataFrame) -> DataFrame:
    """Counts of ``count_messages`` added up."""
    return parts.groupBy("topic", "alert_type", "severity").agg(
        *[F.sum(name).alias(name) for name in ("messages", "errors", "usable")]
    )


def metrics_table(counts: DataFrame) -> DataFrame:
    """All series as rows ``(metric, label, label_value, value)``.

    ``counts`` comes from ``count_messages``. The data is read once: each
    combination contributes to its series, and the zero entries keep the series
    that always exist.
    """

    def sample(metric: str, label: str | None, label_value: Column | None, value: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(metric).alias("metric"),
            (none if label is None else F.lit(label)).alias("label"),
            (none if label_value is None else label_value).alias("label_value"),
            value.cast("bigint").alias("value"),
        )

    contributions = counts.select(
        F.inline(
            F.array(
                sample(MESSAGES_TOTAL, None, None, F.col("messages")),
                sample(MESSAGES_BY_TOPIC, "topic", F.col("topic"), F.col("messages")),
                sample(ALERTS_BY_TYPE, "type", F.col("alert_type"), F.col("usable")),
                sample(ALERTS_BY_SEVERITY, "severity", F.col("severity"), F.col("usable")),
                sample(ERRORS_TOTAL, None, None, F.col("errors")),
            )
        )
    ).where(
        F.col("label").isNull()
        | (F.col("label") == "topic")
        | (F.col("label_value").isNotNull() & (F.col("value") > 0))
    )
    zero = F.lit(0)
    always = counts.sparkSession.range(1, numPartitions=1).select(
        F.inline(
            F.array(
                sample(MESSAGES_TOTAL, None, None, zero),
                *[sample(MESSAGES_BY_TOPIC, "topic", F.lit(t), zero) for t in TOPICS],
                sample(ERRORS_TOTAL, None, None, zero),
            )
        )
    )
    return (
        contributions.unionByName(always)
        .groupBy("metric", "label", "label_value")
        .agg(F.sum("value").alias("value"))
    )
