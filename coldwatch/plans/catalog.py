"""The named queries: operators wired to the ``events`` table.

Every callable takes ``(spark, sf_dir)``. Times are event times: ``as_of`` is
the newest reading, never the clock, so results are repeatable.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.functions.time import utc_clock, utc_instant
from coldwatch.operators.alerts import (
    alert_json,
    alerts_all,
    alerts_primary,
    alerts_wire,
    rule_alerts,
)
from coldwatch.operators.feed import feed_from_readings
from coldwatch.operators.fleet import (
    alerts_active,
    fleet_state,
    fleet_summary,
    known_trucks,
    latest_from_readings,
    latest_per_truck,
    newest_time,
    truck_detail,
    wire_messages,
)
from coldwatch.operators.history import alert_history, alerts_recent, truck_recent_alerts
from coldwatch.operators.intervals import alert_intervals
from coldwatch.operators.metrics import (
    alerts_by_severity,
    alerts_by_type,
    count_messages,
    messages_by_topic,
    metrics_table,
)
from coldwatch.operators.quality import PROBLEMS, telemetry_invalid, telemetry_valid
from coldwatch.operators.routes import route_segments, routes, truck_route, truck_segments
from coldwatch.operators.rules import DEFAULT_RULES
from coldwatch.operators.trips import consecutive_fixes, trip_segments, trip_summary
from coldwatch.schemas import ALERTS_TOPIC, TELEMETRY_FIELDS
from coldwatch.session import run_folder
from coldwatch.sources.events import events_path, read_telemetry, read_wire, stream_telemetry
from coldwatch.sources.wire import decode, decode_errors, telemetry_from_wire, with_wire_problems
from coldwatch.streaming import consumer, jobs

Query = Callable[[SparkSession, str], DataFrame]

# Readings are minutes apart in the test tables, so an alert is let live a day.
MAX_AGE_SECONDS = 86_400
DIGITS = 6

# The consumer's messages come as so many files at least, in two micro-batches or more. A file and
# a micro-batch hold no more of a larger table, so its tasks do not grow with it.
CONSUMER_FILES = 8
CONSUMER_FILE = 50_000  # messages at most
CONSUMER_BATCH = 2_000_000  # about so many messages at most


def _as_of(telemetry: DataFrame) -> Column:
    return telemetry.agg(F.max("ts")).scalar()


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as comma-separated text, to compare with SQL."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({name: F.array_join(name, ",") for name in arrays})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, DIGITS) for name in names})


# --- readings, rules, alerts ---------------------------------------------------


def q_telemetry_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_valid(read_telemetry(spark, sf_dir))


def q_telemetry_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(telemetry_invalid(read_telemetry(spark, sf_dir))).select("event_id", PROBLEMS)


def _rule_query(alert_type: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule_alerts(read_telemetry(spark, sf_dir), alert_type)

    return query


def q_alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_all(read_telemetry(spark, sf_dir))


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_primary(read_telemetry(spark, sf_dir))


def q_alerts_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_primary(spark, sf_dir))


def q_alerts_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_wire(_primary(spark, sf_dir))


# --- wire ------------------------------------------------------------------------


def q_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_errors(decode(read_wire(spark, sf_dir))).select(
        "topic", "event_id", "value", "decode_status", "counted"
    )


def q_wire_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable messages that are no complete reading, with the fields at fault."""
    checked = with_wire_problems(decode(read_wire(spark, sf_dir)))
    wrong = checked.where(F.size("problems") > 0)
    return _flat(wrong.select("event_id", "problems"))


def q_telemetry_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = telemetry_from_wire(decode(read_wire(spark, sf_dir)))
    return decoded.select("event_id", *[name for name, _ in TELEMETRY_FIELDS], "temperature")


def q_metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over the JSON topic: bad messages, and alerts of the usable ones."""
    readings = telemetry_from_wire(decode(read_wire(spark, sf_dir)), usable_only=False)
    feed = feed_from_readings(readings, keep=("counted", "failed"))
    return metrics_table(count_messages(feed))


def _both_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of both topics: the readings, and the alerts raised from those readable."""
    messages = read_wire(spark, sf_dir).select("event_id", "value")
    readings = telemetry_from_wire(decode(messages), usable_only=False)
    feed = feed_from_readings(readings, keep=("value",))
    value = F.when(F.col("topic") == ALERTS_TOPIC, alert_json()).otherwise(F.col("value"))
    return feed.select("topic", "event_id", value.alias("value"))


def _shown(spark: SparkSession, sf_dir: str, latest: DataFrame) -> DataFrame:
    """Fleet state of messages with instants, its times as clocks in UTC show them."""
    as_of = utc_instant(_as_of(read_telemetry(spark, sf_dir)))
    state = fleet_state(latest, as_of, MAX_AGE_SECONDS)
    return state.withColumn("last_seen", utc_clock(F.col("last_seen")))


def q_fleet_state_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet state from the JSON of both topics, as a consumer of them sees it."""
    latest = latest_per_truck(wire_messages(decode(_both_topics(spark, sf_dir))))
    return _shown(spark, sf_dir, latest)


# --- feed and counters -----------------------------------------------------------


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_from_readings(read_telemetry(spark, sf_dir))


def q_live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_feed(spark, sf_dir))


def q_messages_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_by_topic(_feed(spark, sf_dir))


def q_alerts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_by_type(_primary(spark, sf_dir))


def q_alerts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_by_severity(_primary(spark, sf_dir))


# --- history ---------------------------------------------------------------------


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_history(_primary(spark, sf_dir))


def q_alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_history(spark, sf_dir))


def q_alerts_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(alerts_recent(_history(spark, sf_dir)))


def q_alerts_recent_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(alerts_recent(_history(spark, sf_dir), severity="critical"))


def q_alerts_recent_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(alerts_recent(_history(spark, sf_dir), limit=10, alert_type="low_fuel"))


def q_truck_recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(truck_recent_alerts(_history(spark, sf_dir)))


# --- fleet -----------------------------------------------------------------------


def _latest(spark: SparkSession, sf_dir: str, sensors_only: bool = False) -> tuple:
    """The fleet, and the time of the last reading: one scan of the readings gives both.

    The fleet is written first, a row per truck; its newest time is read from there.
    """
    found = latest_from_readings(
        read_telemetry(spark, sf_dir), sensors_only=sensors_only, with_newest=True
    )
    path = f"{_job_folder(spark, 'latest')}/table"
    found.write.parquet(path)
    table = spark.read.schema(found.schema).parquet(path)
    return known_trucks(table), newest_time(table)


def q_fleet_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, as_of = _latest(spark, sf_dir)
    return fleet_state(latest, as_of, MAX_AGE_SECONDS)


def q_fleet_state_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, as_of = _latest(spark, sf_dir, sensors_only=True)
    return fleet_state(latest, as_of, MAX_AGE_SECONDS)


def q_alerts_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, as_of = _latest(spark, sf_dir)
    return _flat(alerts_active(latest, as_of, MAX_AGE_SECONDS))


def q_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet_summary(q_fleet_state(spark, sf_dir))


def q_truck_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest, as_of = _latest(spark, sf_dir)
    recent = truck_recent_alerts(_history(spark, sf_dir))
    detail = truck_detail(latest, recent, as_of=as_of, max_age_seconds=MAX_AGE_SECONDS)
    labels = F.transform(
        "recent_alerts", lambda a: F.concat_ws(":", a["event_id"].cast("string"), a["alert_type"])
    )
    return detail.withColumns(
        {
            "active_alert_type": F.col("active_alert.alert_type"),
            "active_severity": F.col("active_alert.severity"),
            "active_since": F.col("active_alert.timestamp"),
            "recent_alerts": F.array_join(labels, ","),
        }
    ).drop("active_alert")


# --- routes and trips --------------------------------------------------------------


def q_truck_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truck_route(q_fleet_state_telemetry(spark, sf_dir), routes(spark))


def q_route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the route each truck of the fleet is on."""
    segments = _rounded(route_segments(routes(spark)), "distance_km", "heading_degrees")
    return truck_segments(q_truck_route(spark, sf_dir), segments)


def q_trip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = trip_segments(consecutive_fixes(read_telemetry(spark, sf_dir)))
    return _rounded(segments, "elapsed_s", "distance_km", "heading_degrees")


def q_trip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = trip_summary(consecutive_fixes(read_telemetry(spark, sf_dir)))
    return _rounded(summary, "elapsed_s", "distance_km", "fuel_used_pct")


# --- streaming ---------------------------------------------------------------------


def _job_folder(spark: SparkSession, job: str) -> str:
    """The folder of one run; a local session without a shared folder gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix=f"coldwatch-{job}-")
    return run_folder(spark, job)


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_telemetry(spark, events_path(sf_dir))


def q_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _job_folder(spark, "stream_alerts")
    alerts = alerts_primary(_events_stream(spark, sf_dir))
    jobs.start_alerts(alerts, folder).awaitTermination()
    return _flat(jobs.read_alerts(spark, folder))


def q_alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_intervals(_primary(spark, sf_dir), MAX_AGE_SECONDS)


def q_stream_alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals that are over when the stream has been read."""
    folder = _job_folder(spark, "stream_alert_intervals")
    alerts = alerts_primary(_events_stream(spark, sf_dir))
    alerts = alerts.withColumn("timestamp", utc_instant(F.col("timestamp")))
    jobs.start_alert_intervals(alerts, folder, None, MAX_AGE_SECONDS).awaitTermination()
    times = ("active_from", "last_alert", "active_until")
    found = jobs.read_alert_intervals(spark, folder)
    return found.withColumns({name: utc_clock(F.col(name)) for name in times})


def q_stream_fleet_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _job_folder(spark, "stream_fleet_state")
    latest = latest_from_readings(_events_stream(spark, sf_dir))
    jobs.start_fleet_state(latest, folder).awaitTermination()
    as_of = _as_of(read_telemetry(spark, sf_dir))
    return jobs.read_fleet_state(spark, folder, as_of, MAX_AGE_SECONDS)


def q_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _job_folder(spark, "stream_metrics")
    counts = count_messages(feed_from_readings(_events_stream(spark, sf_dir)))
    jobs.start_metrics(counts, folder).awaitTermination()
    return jobs.read_metrics(spark, folder)


def _both_topics_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The messages of both topics as they would come in: a stream of files."""
    messages = _both_topics(spark, sf_dir)
    messages.write.parquet(f"{folder}/messages")
    return spark.readStream.schema(messages.schema).parquet(f"{folder}/messages")


def q_stream_fleet_state_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _job_folder(spark, "stream_fleet_state_wire")
    messages = _both_topics_stream(spark, sf_dir, folder)
    jobs.start_fleet_state_from_wire(messages, folder).awaitTermination()
    return _shown(spark, sf_dir, jobs.read_latest(spark, folder))


def q_stream_metrics_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _job_folder(spark, "stream_metrics_wire")
    messages = _both_topics_stream(spark, sf_dir, folder)
    jobs.start_metrics_from_wire(messages, folder).awaitTermination()
    return jobs.read_metrics(spark, folder)


def _consumed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a consumer that has read both topics, in several micro-batches."""
    folder = _job_folder(spark, "stream_consumer")
    messages = _both_topics(spark, sf_dir)
    events = spark.read.parquet(events_path(sf_dir)).count()  # of each come two messages at most
    most = max(1, min(events // CONSUMER_FILES, CONSUMER_FILE))
    messages.write.option("maxRecordsPerFile", most).parquet(f"{folder}/messages")
    files = len(spark.read.schema(messages.schema).parquet(f"{folder}/messages").inputFiles())
    batches = max(2, math.ceil(2 * events / CONSUMER_BATCH))
    reader = spark.readStream.schema(messages.schema).option(
        "maxFilesPerTrigger", max(1, math.ceil(files / batches))
    )
    consumer.start_consumer(reader.parquet(f"{folder}/messages"), folder).awaitTermination()
    return folder


def q_stream_consumer_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet state as the consumer of both topics keeps it."""
    return _shown(spark, sf_dir, consumer.read_latest(spark, _consumed(spark, sf_dir)))


def q_stream_consumer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumer.read_metrics(spark, _consumed(spark, sf_dir))


def q_stream_alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running history of the alert topic, its times as clocks in UTC show them."""
    history = consumer.read_history(spark, _consumed(spark, sf_dir))
    return _flat(history.withColumn("timestamp", utc_clock(F.col("timestamp"))))


def q_stream_consumer_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = consumer.read_feed(spark, _consumed(spark, sf_dir))
    return _flat(feed.withColumn("timestamp", utc_clock(F.col("timestamp"))))


def q_stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = consumer.read_dead_letters(spark, _consumed(spark, sf_dir))
    return letters.select("topic", "event_id", "value", "decode_status", "counted")


def catalog() -> dict[str, Query]:
    """All named queries."""
    named: dict[str, Query] = {
        "telemetry": read_telemetry,
        "telemetry_valid": q_telemetry_valid,
        "telemetry_invalid": q_telemetry_invalid,
    }
    for rule in DEFAULT_RULES:
        named[f"rule_{rule.alert_type.lower()}"] = _rule_query(rule.alert_type)
    named.update(
        {
            "alerts_all": q_alerts_all,
            "alerts_primary": q_alerts_primary,
            "alerts_wire": q_alerts_wire,
            "decode_errors": q_decode_errors,
            "wire_problems": q_wire_problems,
            "telemetry_decoded": q_telemetry_decoded,
            "metrics_table": q_metrics_table,
            "fleet_state_wire": q_fleet_state_wire,
            "live_feed": q_live_feed,
            "messages_by_topic": q_messages_by_topic,
            "alerts_by_type": q_alerts_by_type,
            "alerts_by_severity": q_alerts_by_severity,
            "alert_history": q_alert_history,
            "alerts_recent": q_alerts_recent,
            "alerts_recent_severity": q_alerts_recent_severity,
            "alerts_recent_type": q_alerts_recent_type,
            "truck_recent_alerts": q_truck_recent_alerts,
            "fleet_state": q_fleet_state,
            "fleet_state_telemetry": q_fleet_state_telemetry,
            "alerts_active": q_alerts_active,
            "fleet_summary": q_fleet_summary,
            "truck_detail": q_truck_detail,
            "truck_route": q_truck_route,
            "route_segments": q_route_segments,
            "trip_segments": q_trip_segments,
            "trip_summary": q_trip_summary,
            "alert_intervals": q_alert_intervals,
            "stream_alerts": q_stream_alerts,
            "stream_alert_intervals": q_stream_alert_intervals,
            "stream_fleet_state": q_stream_fleet_state,
            "stream_metrics": q_stream_metrics,
            "stream_fleet_state_wire": q_stream_fleet_state_wire,
            "stream_metrics_wire": q_stream_metrics_wire,
            "stream_consumer_wire": q_stream_consumer_wire,
            "stream_consumer_metrics": q_stream_consumer_metrics,
            "stream_alert_history": q_stream_alert_history,
            "stream_consumer_feed": q_stream_consumer_feed,
            "stream_dead_letters": q_stream_dead_letters,
        }
    )
    return named
