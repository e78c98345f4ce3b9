import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF
from coldwatch.operators.alerts import alerts_primary
from coldwatch.operators.feed import feed_from_readings
from coldwatch.operators.fleet import fleet_state, latest_from_readings
from coldwatch.operators.metrics import count_messages, messages_by_topic, metrics_table
from coldwatch.plans.catalog import _both_topics, _shown, catalog
from coldwatch.sources.events import events_path, stream_telemetry
from coldwatch.sources.wire import decode, telemetry_from_wire
from coldwatch.streaming import jobs
from coldwatch.streaming.versions import VersionedTables, newest_by


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def files(spark, tmp_path):
    """Events as six files, of which the last two arrive later."""
    events = spark.read.parquet(events_path(SF))
    for i in range(6):
        part = events.where(F.col("event_id") % 6 == i).coalesce(1)
        part.write.parquet(str(tmp_path / ("now" if i < 4 else "later") / f"part={i}"))
    return tmp_path


def stream(spark, files, which="*"):
    # One file per micro-batch, so that state is carried over several of them.
    return stream_telemetry(spark, f"{files}/{which}/part=*", max_files_per_trigger=1)


def run_twice(spark, files, start):
    """Runs on the early files, then again from the checkpoint on all of them."""
    folder = tempfile.mkdtemp(prefix="coldwatch-test-")
    for which in ("now", "*"):
        start(stream(spark, files, which), folder).awaitTermination()
    return folder


def test_alert_stream_equals_batch(spark, telemetry, files):
    folder = run_twice(
        spark, files, lambda df, folder: jobs.start_alerts(alerts_primary(df), folder)
    )
    assert same(jobs.read_alerts(spark, folder), alerts_primary(telemetry))


@pytest.mark.parametrize("snapshot_every", [2, 100])
def test_fleet_stream_equals_batch(spark, telemetry, files, snapshot_every):
    folder = run_twice(
        spark,
        files,
        lambda df, folder: jobs.start_fleet_state(
            latest_from_readings(df), folder, snapshot_every=snapshot_every
        ),
    )
    as_of = telemetry.agg(F.max("ts")).scalar()
    expected = latest_from_readings(telemetry)
    assert same(jobs.read_latest(spark, folder), expected)
    assert same(
        jobs.read_fleet_state(spark, folder, as_of, 86_400),
        fleet_state(expected, as_of, 86_400),
    )


def folders(path: str) -> int:
    return sum(len(names) for _, names, _ in os.walk(path))


def test_many_batches_need_no_more_folders(spark, tmp_path):
    """Writes what 45 micro-batches would, one truck each, and reads in between."""
    schema = "truck_id string, ts bigint"
    tables = VersionedTables(str(tmp_path), {"fleet": newest_by("truck_id")})
    want, most = {}, 0
    for n in range(45):
        want[f"T{n % 7}"] = n
        row = spark.createDataFrame([(f"T{n % 7}", n)], schema).coalesce(1)
        if n % 20 == 3:  # a writer that was begun anew, and sets something else
            tables = VersionedTables(str(tmp_path), {"fleet": newest_by("truck_id")})
        tables.commit(n, {"fleet": row}, 10 if n < 3 else 7)
        if n % 30 == 20:  # a batch that is retried
            tables.commit(n, {"fleet": row}, 10)
        if n % 30 in (0, 6, 20, 29):
            rows = tables.read(spark, "fleet").collect()
            assert {r.truck_id: r.ts for r in rows} == want
            assert tables.version(spark).every == 10
        most = max(most, folders(str(tmp_path)))
    assert most <= 1 + 2 * 10 + 3 + 4


def test_both_topics_stream_equals_batch(spark, tmp_path):
    query = catalog()
    messages = _both_topics(spark, SF)
    for n in range(4):
        part = messages.where(F.pmod(F.xxhash64("topic", "event_id"), F.lit(4)) == n)
        part.coalesce(1).write.parquet(str(tmp_path / f"part={n}"))

    def start(job):
        folder = tempfile.mkdtemp(prefix="coldwatch-test-")
        reader = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1)
        job(reader.parquet(f"{tmp_path}/part=*"), folder).awaitTermination()
        return folder

    state = jobs.read_latest(spark, start(jobs.start_fleet_state_from_wire))
    assert same(_shown(spark, SF, state), query["fleet_state_wire"](spark, SF))
    counts = jobs.read_metrics(spark, start(jobs.start_metrics_from_wire))
    assert same(counts, query["metrics_table"](spark, SF))


def test_counters_equal_batch_and_count_once(spark, telemetry, files):
    folder = run_twice(
        spark,
        files,
        lambda df, folder: jobs.start_metrics(count_messages(feed_from_readings(df)), folder),
    )
    expected = metrics_table(count_messages(feed_from_readings(telemetry)))
    assert same(jobs.read_metrics(spark, folder), expected)


def test_counters_of_nothing(readings):
    feed = feed_from_readings(readings())
    assert {tuple(r) for r in messages_by_topic(feed).collect()} == {("telemetry", 0), ("alerts", 0)}
    table = {tuple(r) for r in metrics_table(count_messages(feed)).collect()}
    assert table == {
        ("logistics_messages_total", None, None, 0),
        ("logistics_messages_by_topic", "topic", "telemetry", 0),
        ("logistics_messages_by_topic", "topic", "alerts", 0),
        ("logistics_errors_total", None, None, 0),
    }


def test_counters_with_bad_messages(spark):
    rows = [
        ("telemetry", 0, '{"truck_id": "T", "humidity_pct": 99}'),
        ("telemetry", 1, "not json"),
        ("telemetry", 2, "[1]"),
        ("telemetry", 3, None),
    ]
    lines = spark.createDataFrame(rows, "topic string, event_id long, value string")
    readings = telemetry_from_wire(decode(lines), usable_only=False)
    feed = feed_from_readings(readings, keep=("counted", "failed"))
    table = {(r.metric, r.label_value): r.value for r in metrics_table(count_messages(feed)).collect()}
    assert table == {
        ("logistics_messages_total", None): 3,
        ("logistics_messages_by_topic", "telemetry"): 2,
        ("logistics_messages_by_topic", "alerts"): 1,
        ("logistics_alerts_by_type", "HUMIDITY_BREACH"): 1,
        ("logistics_alerts_by_severity", "HIGH"): 1,
        ("logistics_errors_total", None): 3,
    }


def test_alerts_without_type_count_as_unknown(spark):
    rows = [("alerts", 0, '{"truck_id": "T"}'), ("alerts", 1, '{"alert_type": "X", "severity": "LOW"}')]
    lines = spark.createDataFrame(rows, "topic string, event_id long, value string")
    feed = decode(lines).select(
        "topic", "document.alert_type", "document.severity", "counted", "failed"
    )
    table = {(r.label, r.label_value): r.value for r in metrics_table(count_messages(feed)).collect()}
    assert table[("type", "UNKNOWN")] == table[("severity", "UNKNOWN")] == 1
    assert table[("type", "X")] == table[("severity", "LOW")] == 1
