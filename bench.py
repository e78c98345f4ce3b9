"""Times the headline queries; prints one JSON line.

Each query is built and run to the last row (written to a sink that drops it):
one warm-up, then the median of ``BENCH_REPS`` runs. Streaming jobs include
start-up, checkpointing and writing their results.

``python bench.py scale`` times some queries over BENCH_ROWS readings (10 million) in 64
files, a third of them of one truck. ``python bench.py latency`` streams such files one
by one and tells how long a micro-batch of alerts takes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from coldwatch.operators.alerts import alerts_primary
from coldwatch.plans.catalog import catalog
from coldwatch.session import local_session
from coldwatch.sources.events import stream_telemetry
from coldwatch.streaming import jobs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))

HEADLINE = [
    "telemetry",
    "alerts_all",
    "alerts_primary",
    "alerts_wire",
    "telemetry_decoded",
    "metrics_table",
    "live_feed",
    "alerts_by_type",
    "alert_history",
    "alerts_recent_severity",
    "fleet_state",
    "fleet_state_wire",
    "alerts_active",
    "fleet_summary",
    "truck_detail",
    "route_segments",
    "trip_segments",
    "trip_summary",
    "stream_alerts",
    "stream_fleet_state",
    "stream_metrics",
    "stream_fleet_state_wire",
    "stream_metrics_wire",
]


AT_SCALE = [
    "alerts_primary", "alerts_wire", "metrics_table", "alert_history", "fleet_state",
    "fleet_state_wire", "alerts_active", "trip_segments", "trip_summary",
]


def many_files(spark: SparkSession, rows: int, files: int) -> str:
    """A folder with an ``events`` table of about ``rows`` rows; a third are one truck's."""
    folder = tempfile.mkdtemp(prefix="coldwatch-bench-")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    count = events.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(rows // count, 1) - 1))).alias("copy")
    spread = events.select("*", copies).repartition(files)
    spread.select(
        (F.col("event_id") + F.col("copy") * count).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(F.col("copy") * 30)).alias("ts"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        "event_type", "value", "props",
    ).write.parquet(f"{folder}/events.parquet")
    return folder


def scale() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "8g"))
    folder = many_files(spark, int(os.environ.get("BENCH_ROWS", 10_000_000)), 64)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in AT_SCALE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalog()[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 2)
    per_second = {n: round(rows / s) for n, s in seconds.items()}
    print(json.dumps({"readings": rows, "seconds": seconds, "readings_per_sec": per_second}))


def latency() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "8g"))
    folder = many_files(spark, int(os.environ.get("BENCH_ROWS", 100_000)), 40)
    stream = stream_telemetry(spark, f"{folder}/events.parquet/*.parquet", max_files_per_trigger=1)
    job = jobs.start_alerts(alerts_primary(stream), f"{folder}/job")
    job.awaitTermination()
    took = [p["durationMs"]["triggerExecution"] for p in job.recentProgress if p["numInputRows"]]
    half = sorted(took[len(took) // 2 :])
    print(json.dumps({"batches": len(took), "median_ms": statistics.median(half), "worst_ms": half[-1]}))


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "8g"))
    queries = catalog()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPS + 1):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "events": events,
                "events_per_sec": {n: round(events / s) for n, s in seconds.items()},
            }
        )
    )


if __name__ == "__main__":
    {"scale": scale, "latency": latency}.get(" ".join(sys.argv[1:]), main)()
