import math
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from coldwatch.operators.routes import ROUTES, route_segments, routes, truck_route, truck_segments
from coldwatch.operators.trips import consecutive_fixes, pieces_for, trip_segments, trip_summary

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2
    h += math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def skewed(n):
    """One truck has most readings, half of them at one instant."""
    out = []
    for i in range(n):
        truck = "HOT" if i % 4 else f"T{i % 12}"
        ts = T0 if i % 2 else T0 + timedelta(seconds=(i * 37) % 1000)
        out.append(
            {"truck_id": truck, "ts": ts, "latitude": 6 + (i * 13 % 97) / 50,
             "longitude": 3 + (i * 7 % 89) / 40, "speed_kmh": float(i * 11 % 90)}
        )
    return out


def brute_force(records):
    by_truck = defaultdict(list)
    for i, r in enumerate(records):
        by_truck[r["truck_id"]].append((r["ts"], i, r))
    pairs = {}
    for timeline in by_truck.values():
        timeline.sort(key=lambda x: x[:2])
        for (t0, _, a), (t1, i, b) in zip(timeline, timeline[1:]):
            distance = km((a["latitude"], a["longitude"]), (b["latitude"], b["longitude"]))
            pairs[i] = ((t1 - t0).total_seconds(), distance)
    return pairs


@pytest.mark.parametrize("pieces", [1, 4, 5, 64, None])
def test_segments_against_brute_force(readings, pieces):
    records = skewed(400)
    fixes = consecutive_fixes(readings(*records), pieces)
    expected = brute_force(records)
    found = {s.event_id: (s.elapsed_s, s.distance_km) for s in trip_segments(fixes).collect()}
    assert found.keys() == expected.keys()
    for i, (seconds, distance) in expected.items():
        assert found[i][0] == seconds
        assert found[i][1] == pytest.approx(distance, abs=1e-9)


def test_pieces_give_the_same_summary(telemetry):
    whole = trip_summary(consecutive_fixes(telemetry, 1))
    cut = trip_summary(consecutive_fixes(telemetry, 13))
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_pieces_are_bounded_by_the_data(readings):
    fixes = readings(*skewed(2000))
    assert pieces_for(fixes, piece_readings=20) == 100
    ranged = fixes.repartitionByRange(100, "truck_id", "ts", "event_id")
    largest = ranged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * 20


def test_plan_reads_once_and_has_no_switch(telemetry):
    plan = consecutive_fixes(telemetry, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange rangepartitioning") == 1
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan


def test_summary(readings):
    df = readings(
        {"truck_id": "A", "ts": T0, "speed_kmh": 80.0},
        {"truck_id": "A", "ts": T0 + timedelta(seconds=1800), "speed_kmh": 60.0},
        {"truck_id": "A", "ts": T0 + timedelta(seconds=5400)},
        {"ts": T0, "speed_kmh": 10.0},
    )
    row = trip_summary(consecutive_fixes(df)).collect()
    assert len(row) == 1
    assert (row[0].readings, row[0].elapsed_s, row[0].distance_km) == (3, 5400.0, 30.0)
    assert row[0].fuel_used_pct == pytest.approx(30 * 0.3 / 4)


def test_route_segments(spark):
    rows = route_segments(routes(spark)).orderBy("route_id", "segment").collect()
    assert len(rows) == 23
    by_route = {route: points for route, _, points in ROUTES}
    for row in rows:
        points = by_route[row.route_id]
        start, end = points[row.segment], points[(row.segment + 1) % len(points)]
        assert (row.start_name, row.end_name, row.road_type) == (start[3], end[3], start[2])
        assert row.distance_km == pytest.approx(km(start, end), abs=1e-9)
        assert 0 <= row.heading_degrees < 360
        limits = {"highway": (70, 100), "urban": (25, 45)}[start[2]]
        assert (row.min_speed_kmh, row.max_speed_kmh) == limits


def test_other_road_types(spark):
    table = spark.sql(
        "SELECT 'R' AS route_id, array(named_struct('latitude', 0D, 'longitude', 0D, 'road_type', 'dirt', 'name', 'a'),"
        " named_struct('latitude', 0D, 'longitude', 1D, 'road_type', 'loading_zone', 'name', 'b')) AS waypoints"
    )
    first, second = route_segments(table).orderBy("segment").collect()
    assert (first.min_speed_kmh, first.max_speed_kmh, first.heading_degrees) == (40, 60, 90)
    assert (second.min_speed_kmh, second.max_speed_kmh, second.heading_degrees) == (0, 5, 270)


def test_unknown_route_falls_back_to_the_first(spark):
    trucks = spark.createDataFrame(
        [("A", "RT-BEN-ABJ"), ("B", "UNKNOWN"), ("C", None)], "truck_id string, route_id string"
    )
    assigned = truck_route(trucks, routes(spark))
    found = {r.truck_id: (r.route_id, r.waypoints) for r in assigned.collect()}
    assert found == {"A": ("RT-BEN-ABJ", 7), "B": ("RT-LAG-ABJ", 9), "C": ("RT-LAG-ABJ", 9)}
    assert truck_segments(assigned, route_segments(routes(spark))).count() == 25


def test_the_fallback_is_the_first_route_of_the_table(spark):
    others = routes(spark).where("route_pos > 0")
    trucks = spark.createDataFrame([("A", None), ("B", ROUTES[2][0]), ("C", ROUTES[0][0])], "truck_id string, route_id string")
    found = {r.truck_id: r for r in truck_route(trucks, others).collect()}
    assert [found[t].route_id for t in "ABC"] == [ROUTES[1][0], ROUTES[2][0], ROUTES[1][0]]
    assert found["A"].route_name == ROUTES[1][1] and found["A"].waypoints == len(ROUTES[1][2])
    empty = truck_route(trucks, others.limit(0)).where("truck_id = 'A'").first()
    assert empty.route_id is None and empty.waypoints is None
