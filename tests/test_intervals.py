"""Active intervals: session edges, late alerts, a restart in between."""

import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coldwatch.operators.intervals import alert_intervals
from coldwatch.streaming import jobs

SCHEMA = "truck_id string, timestamp timestamp, event_id bigint"
START = datetime(2024, 5, 1, 12)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def rows(found) -> set:
    return {
        (r.truck_id, r.active_from, r.last_alert, r.active_until, r.alerts) for r in found.collect()
    }


def interval(truck: str, first: float, last: float, n: int, age: int = 30) -> tuple:
    return truck, at(first), at(last), at(last + age), n


def test_edges(spark):
    alerts = [("T", at(0), 1), ("T", at(30), 2), ("T", at(60.000001), 3), ("U", at(5), 4), ("U", at(5), 5)]
    alerts += [(None, at(1), 6), ("", at(1), 7), ("V", None, 8)]
    found = alert_intervals(spark.createDataFrame(alerts, SCHEMA))
    assert rows(found) == {
        interval("T", 0, 30, 2), interval("T", 60.000001, 60.000001, 1), interval("U", 5, 5, 2),
    }
    assert alert_intervals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_gives_what_is_over_and_takes_late_alerts(spark, tmp_path):
    batches = [
        [("T", at(0), 1), ("U", at(10), 2)],
        [("T", at(40), 3)],
        [("T", at(25), 4), ("U", at(100), 5)],  # late, but in time to join T's two intervals
        [("T", at(20), 6), ("W", at(300), 7)],  # too late
        [("W", at(301), 8)],
    ]
    folder = tempfile.mkdtemp(prefix="coldwatch-test-")
    for n, alerts in enumerate(batches):
        spark.createDataFrame(alerts, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        # Begun anew for every batch, from the checkpoint.
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/part=*")
        jobs.start_alert_intervals(stream, folder, late="20 seconds").awaitTermination()
        found = rows(jobs.read_alert_intervals(spark, folder))
        if n < 2:
            assert found == set()
    assert found == {interval("T", 0, 40, 3), interval("U", 10, 10, 1), interval("U", 100, 100, 1)}


def test_partial_sessions_are_merged_before_the_shuffle(spark):
    alerts = spark.range(1000).select(
        F.lit("T").alias("truck_id"), F.timestamp_seconds("id").alias("timestamp")
    )
    assert alert_intervals(alerts).count() == 1
