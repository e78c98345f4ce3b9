"""Telemetry to alerts: every alert, the primary one per reading, the wire form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.functions.time import iso_utc
from coldwatch.operators.rules import DEFAULT_RULES, Rule, RuleBook
from coldwatch.schemas import ALERT_FIELDS, PRIMARY_ALERT_FIELDS

UNKNOWN = "UNKNOWN"


def alert_context(now: Column | None = None) -> list[Column]:
    """What an alert repeats of its reading. ``now`` stands in for a missing time."""
    timestamp = F.col("ts") if now is None else F.coalesce(F.col("ts"), now)
    return [
        F.col("truck_id"),
        timestamp.alias("timestamp"),
        F.col("latitude"),
        F.col("longitude"),
        F.coalesce(F.col("route_id"), F.lit(UNKNOWN)).alias("route_id"),
        F.coalesce(F.col("driver_id"), F.lit(UNKNOWN)).alias("driver_id"),
        F.coalesce(F.col("status"), F.lit(UNKNOWN)).alias("status"),
    ]


FIRED, VARIANT = "_fired", "_variant"


def with_fired(telemetry: DataFrame, book: RuleBook) -> DataFrame:
    """Adds what each reading raises; see ``RuleBook.fired``."""
    return telemetry.withColumn(FIRED, book.fired())


def with_primary(df: DataFrame, book: RuleBook, fired: Column | None = None) -> DataFrame:
    """Looks up the primary alert, after ``with_fired``.

    ``fired`` overrides that column; where it is NULL there is no alert.
    """
    fired = F.col(FIRED) if fired is None else fired
    return df.select(
        "*",
        *book.look_up(book.primary_variant(fired)),
        book.total(fired).alias("total_alerts"),
        book.others(fired).alias("additional_alerts"),
    )


def primary_alert_columns(book: RuleBook, now: Column | None = None) -> list[Column]:
    """The fields of the primary alert, after ``with_primary``."""
    return [
        *book.describe(),
        *alert_context(now),
        F.col("total_alerts"),
        F.col("additional_alerts"),
    ]


def alerts_primary(
    telemetry: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, now: Column | None = None
) -> DataFrame:
    """The most severe alert of each reading that raises any.

    Row-local: no shuffle, and usable on a stream in append mode.
    """
    book = RuleBook(rules)
    # Exploding none or one element, since a filter would be pushed below the
    # projection and evaluate every condition a second time.
    raised = with_fired(telemetry, book).withColumn(
        FIRED, F.explode(F.when(book.raised(F.col(FIRED)), F.array(FIRED)))
    )
    return with_primary(raised, book).select("event_id", *primary_alert_columns(book, now))


def alerts_all(
    telemetry: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, now: Column | None = None
) -> DataFrame:
    """One row per reading and rule that fires, from a single pass over the readings."""
    book = RuleBook(rules)
    fired = telemetry.withColumn(VARIANT, F.explode(book.each_variant()))
    described = fired.select("*", *book.look_up(F.col(VARIANT)))
    return described.select("event_id", *book.describe(), *alert_context(now))


def rule_alerts(
    telemetry: DataFrame,
    alert_type: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    now: Column | None = None,
) -> DataFrame:
    """The alerts of one rule."""
    wanted = [rule for rule in rules if rule.alert_type == alert_type]
    if not wanted:
        raise ValueError(f"no rule raises {alert_type}")
    return alerts_all(telemetry, wanted, now)


def alert_json(fields: Sequence[str] = PRIMARY_ALERT_FIELDS) -> Column:
    """An alert as JSON text: numbers as numbers, absent fields left out."""

    def number_or_text(name: str) -> Column:
        number = F.col(name).try_cast("double").cast("variant")
        return F.coalesce(number, F.col(name).cast("variant")).alias(name)

    written = {
        "threshold": number_or_text("threshold"),
        "actual_value": number_or_text("actual_value"),
        "timestamp": iso_utc(F.col("timestamp")).alias("timestamp"),
    }
    return F.to_json(F.struct(*[written.get(name, F.col(name)) for name in fields]))


def alerts_wire(alerts: DataFrame) -> DataFrame:
    """Alerts as keyed JSON messages."""
    present = PRIMARY_ALERT_FIELDS if "total_alerts" in alerts.columns else ALERT_FIELDS
    return alerts.select(
        "event_id", F.col("truck_id").alias("key"), alert_json(present).alias("value")
    )
