"""The plans are the ones to run at scale."""

import re

import pytest

from coldwatch.operators.alerts import alerts_all, alerts_primary, alerts_wire
from coldwatch.operators.feed import feed_from_readings
from coldwatch.operators.fleet import fleet_state, latest_from_readings
from coldwatch.operators.history import alert_history, alerts_recent
from coldwatch.operators.metrics import alerts_by_type, count_messages
from coldwatch.operators.trips import consecutive_fixes, trip_segments
from coldwatch.plans.catalog import _both_topics, catalog

# HotSpot does not compile methods above this many bytes.
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def table(spark, telemetry, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "telemetry")
    telemetry.write.parquet(path)
    return spark.read.parquet(path)


def explain(df, mode="simple"):
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString(mode))


NARROW = [alerts_primary, alerts_all, feed_from_readings, lambda t: alerts_wire(alerts_primary(t))]


@pytest.mark.parametrize("operator", NARROW)
def test_row_local_operators(table, operator):
    plan = explain(operator(table))
    assert "Exchange" not in plan
    assert plan.count("FileScan") == 1
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explain(operator(table), "codegen"))]
    assert sizes and max(sizes) <= JIT_LIMIT


def test_counting_reads_only_what_rules_need(table):
    plan = explain(alerts_by_type(alerts_primary(table)), "formatted")
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "odometer_km" not in schema and "latitude" not in schema and "driver_id" not in schema
    assert "partial_count" in plan


def test_history_is_a_top_k(table):
    plan = explain(alerts_recent(alert_history(alerts_primary(table)), severity="HIGH"))
    inner = plan.index("TakeOrderedAndProject(limit=100")
    assert plan.index("TakeOrderedAndProject(limit=50") < plan.index("Filter") < inner
    assert "Exchange" not in plan


def test_latest_is_one_shuffle_after_partial_aggregation(table):
    plan = explain(fleet_state(latest_from_readings(table)))
    assert plan.count("Exchange hashpartitioning(truck_id") == plan.count("Exchange") == 1
    assert "partial_max_by" in plan and "Window" not in plan
    assert "IsNotNull(truck_id)" in plan


def test_counters_read_once(table):
    plan = explain(count_messages(feed_from_readings(table)))
    assert plan.count("FileScan") == plan.count("Exchange") == 1 and "partial_count" in plan


def test_both_topics_come_from_one_scan(spark):
    plan = explain(_both_topics(spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    plan = explain(catalog()["fleet_state_wire"](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 2  # the other only for the newest time


@pytest.mark.parametrize("name", ["fleet_state", "alerts_active", "fleet_summary"])
def test_the_newest_time_takes_no_second_scan(spark, table, name):
    assert explain(latest_from_readings(table, with_newest=True)).count("FileScan") == 1
    plan = explain(catalog()[name](spark, "/root/testdata/sf0.001"), "formatted")
    assert "sf0.001" not in plan and "events" not in plan


def test_trips_have_one_path_without_joins(table):
    plan = explain(trip_segments(consecutive_fixes(table)))
    assert "Join" not in plan and "Broadcast" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", [n for n in sorted(catalog()) if not n.startswith("stream_")])
def test_no_python_and_no_cross_join(spark, name):
    plan = explain(catalog()[name](spark, "/root/testdata/sf0.001"))
    for bad in ("Python", "Pandas", "Cartesian", "NestedLoop"):
        assert bad not in plan
