"""The live feed: both topics in one stream, each record tagged with its topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.operators.alerts import FIRED, primary_alert_columns, with_fired, with_primary
from coldwatch.operators.rules import DEFAULT_RULES, Rule, RuleBook
from coldwatch.schemas import (
    ALERT_RULE_FIELDS,
    ALERTS_TOPIC,
    LEGACY_TEMPERATURE,
    PRIMARY_ALERT_FIELDS,
    TELEMETRY_FIELDS,
    TELEMETRY_TOPIC,
)

_SENSOR_FIELDS = [name for name, _ in TELEMETRY_FIELDS] + [LEGACY_TEMPERATURE]
_ALERT_ONLY = [*ALERT_RULE_FIELDS, "total_alerts", "additional_alerts"]
FEED_FIELDS = ["topic", "event_id", *_SENSOR_FIELDS, *_ALERT_ONLY]


def _readings_as_feed(telemetry: DataFrame) -> DataFrame:
    return telemetry.withColumnRenamed("ts", "timestamp").select("event_id", *_SENSOR_FIELDS)


def live_feed(telemetry: DataFrame, alerts: DataFrame) -> DataFrame:
    """Bag union of two existing topics; no shuffle."""
    readings = _readings_as_feed(telemetry).withColumn("topic", F.lit(TELEMETRY_TOPIC))
    raised = alerts.select("event_id", *PRIMARY_ALERT_FIELDS).withColumn(
        "topic", F.lit(ALERTS_TOPIC)
    )
    return readings.unionByName(raised, allowMissingColumns=True).select(*FEED_FIELDS)


def feed_from_readings(
    telemetry: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    now: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The same feed when alerts are yet to be derived: one scan instead of two.

    ``keep`` names further columns of the readings to carry along.
    """
    book = RuleBook(rules)
    one, both = F.array(F.lit(TELEMETRY_TOPIC)), F.array(F.lit(TELEMETRY_TOPIC), F.lit(ALERTS_TOPIC))
    tagged = with_fired(telemetry, book).withColumn(
        "topic", F.explode(F.when(book.raised(F.col(FIRED)), both).otherwise(one))
    )
    is_alert = F.col("topic") == ALERTS_TOPIC
    # On the reading's own row nothing counts as fired, so the alert fields are NULL.
    looked_up = with_primary(tagged, book, F.when(is_alert, F.col(FIRED)))
    alert = dict(zip(PRIMARY_ALERT_FIELDS, primary_alert_columns(book, now)))

    def field(name: str) -> Column:
        if name in _ALERT_ONLY:
            return alert[name].alias(name)
        own = F.col("ts" if name == "timestamp" else name)
        mine = F.when(~is_alert, own)
        return (mine.otherwise(alert[name]) if name in alert else mine).alias(name)

    return looked_up.select(
        "topic", "event_id", *[field(name) for name in [*_SENSOR_FIELDS, *_ALERT_ONLY]], *keep
    )
