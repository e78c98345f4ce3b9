"""The fleet as last heard of: state per truck, active alerts, summary, detail.

Both topics feed the state. A message is ``(truck_id, ts, topic_rank, event_id)``
with the ``state`` it leaves the truck in and the ``alert`` it carries, if any.
The latest message of a truck wins as a whole, so an alert blanks the sensor
columns it does not carry until the next reading. "Latest" is event time, then
topic (an alert follows its reading), then sequence number.

Everything per truck comes from one ``max_by`` aggregation: map tasks reduce to
one row per truck before the shuffle, so a truck with a third of all messages
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.functions.time import not_older_than, parse_utc
from coldwatch.operators.alerts import (
    FIRED,
    alert_context,
    primary_alert_columns,
    with_fired,
    with_primary,
)
from coldwatch.operators.rules import DEFAULT_RULES, Rule, RuleBook
from coldwatch.schemas import (
    ALERT_CONTEXT_FIELDS,
    ALERTS_TOPIC,
    LEGACY_TEMPERATURE,
    PRIMARY_ALERT_FIELDS,
    STATE_FIELDS,
    TELEMETRY_TOPIC,
    TOPICS,
)

# Seconds an alert stays active without being repeated.
DEFAULT_MAX_AGE_SECONDS = 30

_ORDER = ["ts", "topic_rank", "event_id"]


def _reading_state(overwritten: Column, now: Column | None = None) -> Column:
    """The state a reading leaves, or that of its alert where that overwrites it.

    An alert tells where the truck is, but not what its sensors read.
    """
    told = dict(zip(ALERT_CONTEXT_FIELDS, alert_context(now)))

    def either(own: Column, from_alert: Column | None) -> Column:
        chosen = F.when(~overwritten, own)
        return chosen if from_alert is None else chosen.otherwise(from_alert)

    return F.struct(
        either(F.col("ts"), told["timestamp"]).alias("last_seen"),
        F.col("latitude"),
        F.col("longitude"),
        either(F.coalesce(F.col("speed_kmh"), F.lit(0.0)), F.lit(0.0)).alias("speed_kmh"),
        either(F.coalesce("temperature_c", LEGACY_TEMPERATURE), None).alias("temperature_c"),
        either(F.col("fuel_level_pct"), None).alias("fuel_level_pct"),
        either(F.col("door_status"), None).alias("door_status"),
        either(F.col("status"), told["status"]).alias("status"),
        either(F.col("driver_id"), told["driver_id"]).alias("driver_id"),
        either(F.col("route_id"), told["route_id"]).alias("route_id"),
    )


def _alert_state() -> Column:
    return F.struct(
        F.col("timestamp").alias("last_seen"),
        F.col("latitude"),
        F.col("longitude"),
        F.lit(0.0).alias("speed_kmh"),
        F.lit(None).cast("double").alias("temperature_c"),
        F.lit(None).cast("double").alias("fuel_level_pct"),
        F.lit(None).cast("string").alias("door_status"),
        F.col("status"),
        F.col("driver_id"),
        F.col("route_id"),
    )


def known_trucks(df: DataFrame) -> DataFrame:
    return df.where(F.col("truck_id").isNotNull() & (F.col("truck_id") != ""))


def topic_messages(telemetry: DataFrame, alerts: DataFrame) -> DataFrame:
    """Messages of the two topics, when both exist as tables or streams."""
    readings = known_trucks(telemetry).select(
        "truck_id",
        "ts",
        F.lit(TOPICS.index(TELEMETRY_TOPIC)).alias("topic_rank"),
        "event_id",
        _reading_state(overwritten=F.lit(False)).alias("state"),
    )
    raised = known_trucks(alerts).select(
        "truck_id",
        F.col("timestamp").alias("ts"),
        F.lit(TOPICS.index(ALERTS_TOPIC)).alias("topic_rank"),
        "event_id",
        _alert_state().alias("state"),
        F.struct(*PRIMARY_ALERT_FIELDS).alias("alert"),
    )
    return readings.unionByName(raised, allowMissingColumns=True)


def wire_messages(decoded: DataFrame) -> DataFrame:
    """Messages of both topics out of one decoded source (``wire.decode``), in one pass."""
    both = decoded.select(
        "topic", "event_id", F.inline(F.when(F.col("document").isNotNull(), F.array("document")))
    ).withColumn("timestamp", parse_utc(F.col("timestamp")))
    is_alert = F.col("topic") == ALERTS_TOPIC
    # The reading's state is built from ``ts``; an alert repeats its reading's time.
    known = known_trucks(both.withColumn("ts", F.col("timestamp")))
    return known.select(
        "truck_id",
        "ts",
        F.when(is_alert, TOPICS.index(ALERTS_TOPIC))
        .otherwise(TOPICS.index(TELEMETRY_TOPIC))
        .alias("topic_rank"),
        "event_id",
        F.when(is_alert, _alert_state())
        .otherwise(_reading_state(overwritten=F.lit(False)))
        .alias("state"),
        F.when(is_alert, F.struct(*PRIMARY_ALERT_FIELDS)).alias("alert"),
    )


def latest_from_readings(
    telemetry: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    now: Column | None = None,
    sensors_only: bool = False,
    with_newest: bool = False,
) -> DataFrame:
    """``latest_per_truck`` straight from telemetry, deriving the alerts in the same scan.

    A reading's alert has the reading's time and outranks it, so only the later
    of the two can decide the state: one message per reading, not two. With
    ``sensors_only`` alerts are carried along but do not overwrite the state.

    What travels through the aggregation is the reading. Alert texts are made
    afterwards, for the one reading per truck that is left.

    ``with_newest`` adds ``newest``, the time of a truck's last reading, and a row without
    ``truck_id`` for the readings that name none, so that ``newest_time`` knows the time of
    the last of all readings without another scan. Drop that row with ``known_trucks``.
    """
    book = RuleBook(rules)
    context = [c for c in ALERT_CONTEXT_FIELDS if c not in ("truck_id", "timestamp")]
    used = list(dict.fromkeys([*context, *book.columns_used()]))
    alert_time = dict(zip(ALERT_CONTEXT_FIELDS, alert_context(now)))["timestamp"]
    alerted = book.raised(F.col(FIRED))
    named = F.when(F.col("truck_id") != "", F.col("truck_id"))
    told = telemetry.withColumn("truck_id", named) if with_newest else known_trucks(telemetry)
    messages = with_fired(told, book).select(
        "truck_id",
        F.col("ts"),
        (F.lit(0) if sensors_only else F.when(alerted, 1).otherwise(0)).alias("topic_rank"),
        "event_id",
        _reading_state(overwritten=F.lit(False) if sensors_only else alerted, now=now).alias(
            "state"
        ),
        F.when(alerted, F.struct(FIRED, alert_time.alias("ts"), *used)).alias("alert"),
    )
    newest = [F.max("ts").alias("newest")] if with_newest else []
    last = _latest(messages, "ts", *newest)
    raised = with_primary(last.select("*", "alert.*").drop("alert"), book)
    fields = primary_alert_columns(book)
    alert = F.when(F.col("alerts_seen") > 0, F.struct(*fields)).alias("alert")
    added = ["newest"] if with_newest else []
    return raised.select("truck_id", "state", alert, "alert_ts", "alerts_seen", *added)


def newest_time(latest: DataFrame) -> Column:
    """The time of the last reading of all, from ``latest_from_readings(with_newest=True)``.

    Pass a written table: of a plan, this would be computed a second time.
    """
    return latest.agg(F.max("newest")).scalar()


def _latest(messages: DataFrame, alert_time: str, *more: Column) -> DataFrame:
    order = F.struct(*_ORDER)
    carries = F.col("alert").isNotNull()
    return messages.groupBy("truck_id").agg(
        F.max_by("state", order).alias("state"),
        F.max_by("alert", F.when(carries, order)).alias("alert"),
        F.max(F.when(carries, F.col(f"alert.{alert_time}"))).alias("alert_ts"),
        F.count(F.when(carries, 1)).alias("alerts_seen"),
        *more,
    )


def latest_per_truck(messages: DataFrame) -> DataFrame:
    """Per truck: last ``state``, last ``alert``, its time, and how many there were."""
    return _latest(messages, alert_time="timestamp")


def partial_latest(messages: DataFrame) -> DataFrame:
    """What some messages tell of each truck, with the order that decides between parts."""
    order = F.struct(*_ORDER)
    carries = F.col("alert").isNotNull()
    ordered = messages.select(
        "truck_id", order.alias("order"), "state",
        F.when(carries, order).alias("alert_order"), "alert",
        F.col("alert.timestamp").alias("alert_ts"),
        F.when(carries, 1).otherwise(0).cast("bigint").alias("alerts_seen"),
    )
    return merge_latest(ordered)


def merge_latest(parts: DataFrame) -> DataFrame:
    """Parts of ``partial_latest`` put together; merging in any order gives the same."""
    return parts.groupBy("truck_id").agg(
        F.max("order").alias("order"),
        F.max_by("state", "order").alias("state"),
        F.max("alert_order").alias("alert_order"),
        F.max_by("alert", "alert_order").alias("alert"),
        F.max("alert_ts").alias("alert_ts"),
        F.sum("alerts_seen").alias("alerts_seen"),
    )


def latest_of_parts(merged: DataFrame) -> DataFrame:
    """``latest_per_truck`` of all messages whose parts were merged."""
    return merged.drop("order", "alert_order")


def _alert_is_active(as_of: Column, max_age_seconds: float) -> Column:
    return (F.col("alerts_seen") > 0) & not_older_than(F.col("alert_ts"), as_of, max_age_seconds)


def fleet_state(
    latest: DataFrame,
    as_of: Column | None = None,
    max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS,
) -> DataFrame:
    """One row per truck with its last known state and whether an alert is active."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return latest.select(
        "truck_id",
        *[F.col(f"state.{name}").alias(name) for name in STATE_FIELDS],
        _alert_is_active(as_of, max_age_seconds).alias("has_active_alert"),
    )


def alerts_active(
    latest: DataFrame,
    as_of: Column | None = None,
    max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS,
) -> DataFrame:
    """The latest alert of each truck, unless it has gone stale.

    Staleness is judged after picking the latest: a stale alert does not bring
    back an older one.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    return latest.where(_alert_is_active(as_of, max_age_seconds)).select(
        "truck_id",
        *[F.col(f"alert.{f}").alias(f) for f in PRIMARY_ALERT_FIELDS if f != "truck_id"],
    )


def fleet_summary(state: DataFrame) -> DataFrame:
    """Fleet totals in one row, zeros for an empty fleet."""
    return state.agg(
        F.count("*").alias("total_trucks"),
        F.count_if("has_active_alert").alias("trucks_with_alerts"),
        F.count_if(F.col("status") == "IN_TRANSIT").alias("trucks_in_transit"),
        F.count_if(F.col("status") == "DOCKED").alias("trucks_docked"),
        F.count_if(F.col("status") == "LOADING").alias("trucks_loading"),
    )


def truck_detail(
    latest: DataFrame,
    recent: DataFrame,
    truck_id: str | None = None,
    as_of: Column | None = None,
    max_age_seconds: float = DEFAULT_MAX_AGE_SECONDS,
) -> DataFrame:
    """State, active alert and recent alerts of one truck, or of every truck.

    ``recent`` is ``history.truck_recent_alerts``; its size is bounded by the
    alert history. An unknown truck gives no row.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    if truck_id is not None:
        latest = latest.where(F.col("truck_id") == truck_id)
        recent = recent.where(F.col("truck_id") == truck_id)
    active = _alert_is_active(as_of, max_age_seconds)
    state = latest.select(
        "truck_id",
        *[F.col(f"state.{name}").alias(name) for name in STATE_FIELDS],
        active.alias("has_active_alert"),
        F.when(active, F.col("alert")).alias("active_alert"),
    )
    # Bounded: at most the alert history in total, ten alerts per truck.
    entry = F.struct("recency", *[c for c in recent.columns if c not in ("truck_id", "recency")])
    lists = recent.groupBy("truck_id").agg(
        F.sort_array(F.collect_list(entry)).alias("recent_alerts")
    )
    return state.join(lists, "truck_id", "left")
