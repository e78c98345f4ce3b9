from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from coldwatch.operators.alerts import alerts_primary, alerts_wire
from coldwatch.operators.feed import feed_from_readings, live_feed
from coldwatch.operators.fleet import (
    alerts_active,
    fleet_state,
    fleet_summary,
    known_trucks,
    latest_from_readings,
    latest_per_truck,
    newest_time,
    topic_messages,
    truck_detail,
    wire_messages,
)
from coldwatch.operators.history import alert_history, alerts_recent, truck_recent_alerts
from coldwatch.operators.quality import telemetry_invalid, telemetry_valid
from coldwatch.sources.wire import decode, telemetry_to_wire

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def as_of(seconds):
    return F.lit(at(seconds))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_last_message_replaces_the_row(readings):
    df = readings(
        {"truck_id": "A", "ts": at(0), "speed_kmh": 50.0, "fuel_level_pct": 80.0, "door_status": "OPEN"},
        {"truck_id": "A", "ts": at(9), "temperature": -18.0, "status": "DOCKED"},
        {"truck_id": "A", "ts": at(5), "speed_kmh": 70.0},
    )
    row = fleet_state(latest_from_readings(df), as_of(10)).first()
    assert (row.speed_kmh, row.temperature_c, row.fuel_level_pct) == (0.0, -18.0, None)
    assert (row.door_status, row.status, row.has_active_alert) == (None, "DOCKED", True)


def test_alert_blanks_sensors(readings):
    record = {"truck_id": "A", "ts": at(0), "speed_kmh": 60.0, "fuel_level_pct": 9.0, "latitude": 6.5}
    df = readings({**record, "door_status": "CLOSED"})
    row = fleet_state(latest_from_readings(df), as_of(0)).first()
    assert (row.speed_kmh, row.fuel_level_pct, row.door_status) == (0.0, None, None)
    assert (row.latitude, row.driver_id, row.has_active_alert) == (6.5, "UNKNOWN", True)
    sensors = fleet_state(latest_from_readings(df, sensors_only=True), as_of(0)).first()
    assert (sensors.speed_kmh, sensors.fuel_level_pct, sensors.driver_id) == (60.0, 9.0, None)
    assert sensors.has_active_alert


def test_equal_times_go_by_sequence(readings):
    df = readings(*[{"truck_id": "A", "ts": at(0), "odometer_km": 1.0, "status": s} for s in "XYZ"])
    assert fleet_state(latest_from_readings(df), as_of(0)).first().status == "Z"


def test_trucks_without_id_are_skipped(readings):
    df = readings({"ts": at(0), "humidity_pct": 99.0}, {"truck_id": "", "ts": at(0)})
    assert latest_from_readings(df).count() == 0
    assert alerts_primary(df).count() == 1


@pytest.mark.parametrize("age,active", [(30, True), (30.000001, False)])
def test_expiry_is_strict(readings, age, active):
    df = readings({"truck_id": "A", "ts": at(0), "humidity_pct": 99.0})
    now = F.lit(T0 + timedelta(seconds=age))
    latest = latest_from_readings(df)
    assert alerts_active(latest, now).count() == int(active)
    assert fleet_state(latest, now).first().has_active_alert is active


def test_missing_time_never_expires(readings):
    df = readings({"truck_id": "A", "humidity_pct": 99.0})
    assert alerts_active(latest_from_readings(df), as_of(10**9)).count() == 1


def test_latest_alert_not_worst_and_no_revival(readings):
    df = readings(
        {"truck_id": "A", "ts": at(0), "compressor_status": "FAULT"},
        {"truck_id": "A", "ts": at(1), "battery_voltage": 11.0},
    )
    latest = latest_from_readings(df)
    assert alerts_active(latest, as_of(2)).first().alert_type == "BATTERY_LOW"
    older = readings(
        {"truck_id": "A", "ts": at(100), "battery_voltage": 11.0},
        {"truck_id": "A", "ts": at(0), "compressor_status": "FAULT"},
    )
    assert alerts_active(latest_from_readings(older), as_of(131)).count() == 0


def test_three_ways_to_the_same_state(telemetry):
    alerts = alerts_primary(telemetry)
    derived = latest_from_readings(telemetry)
    joined = latest_per_truck(topic_messages(telemetry, alerts))
    assert same(derived, joined)
    lines = telemetry_to_wire(telemetry).withColumn("topic", F.lit("telemetry")).unionByName(
        alerts_wire(alerts).withColumn("topic", F.lit("alerts"))
    )
    from_wire = fleet_state(latest_per_truck(wire_messages(decode(lines))), as_of(0))
    assert same(
        from_wire.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")),
        fleet_state(derived, as_of(0)),
    )


def test_feed_from_readings_is_the_union(telemetry):
    assert same(feed_from_readings(telemetry), live_feed(telemetry, alerts_primary(telemetry)))


def test_partitioning_does_not_matter(telemetry):
    assert same(latest_from_readings(telemetry.repartition(9)), latest_from_readings(telemetry))


def test_empty_fleet(readings):
    row = fleet_summary(fleet_state(latest_from_readings(readings()), as_of(0))).first()
    assert set(row.asDict().values()) == {0} and len(row) == 5


def test_history_then_filter(readings):
    records = [{"truck_id": "A", "ts": at(0), "compressor_status": "FAULT"}]
    records += [{"truck_id": "B", "ts": at(i), "battery_voltage": 11.0} for i in range(1, 121)]
    history = alert_history(alerts_primary(readings(*records)))
    assert [a.event_id for a in history.collect()] == list(range(120, 20, -1))
    # The older alert has left the history, so filters do not find it.
    assert alerts_recent(history, severity="critical").count() == 0
    assert truck_recent_alerts(history, "A").count() == 0
    recent = alerts_recent(history, limit=3, severity="medium", alert_type="battery_low").collect()
    assert [a.event_id for a in recent] == [120, 119, 118]
    assert alerts_recent(history, severity="").count() == 50
    mine = truck_recent_alerts(history, "B").orderBy("recency").collect()
    assert [a.event_id for a in mine] == list(range(120, 110, -1))
    for limit in (0, 101):
        with pytest.raises(ValueError):
            alerts_recent(history, limit=limit)


def test_truck_detail(readings):
    df = readings(
        {"truck_id": "A", "ts": at(0), "humidity_pct": 95.0},
        {"truck_id": "A", "ts": at(5), "battery_voltage": 11.0},
        {"truck_id": "B", "ts": at(6)},
    )
    latest, recent = latest_from_readings(df), truck_recent_alerts(alert_history(alerts_primary(df)))
    row = truck_detail(latest, recent, "A", as_of(10)).first()
    assert row.active_alert.alert_type == "BATTERY_LOW"
    assert [a.alert_type for a in row.recent_alerts] == ["BATTERY_LOW", "HUMIDITY_BREACH"]
    stale = truck_detail(latest, recent, "A", as_of(100)).first()
    assert stale.active_alert is None and len(stale.recent_alerts) == 2
    calm = truck_detail(latest, recent, "B", as_of(10)).first()
    assert calm.active_alert is None and calm.recent_alerts is None
    assert truck_detail(latest, recent, "C", as_of(10)).count() == 0


def test_validation_splits(telemetry):
    valid, invalid = telemetry_valid(telemetry), telemetry_invalid(telemetry)
    assert valid.count() + invalid.count() == telemetry.count()
    assert invalid.where("size(missing_fields) = 0").count() == 0
    first = invalid.where("event_id = 0").first()
    assert first.missing_fields == ["truck_id", "speed_kmh", "temperature_c", "door_status", "driver_id"]


def test_newest_time_counts_readings_without_a_truck(readings):
    df = readings({"truck_id": "A", "ts": at(1)}, {"truck_id": "", "ts": at(5)}, {"ts": at(4)}, {"truck_id": "B"})
    found = latest_from_readings(df, with_newest=True)
    assert found.select(newest_time(found).alias("t")).first().t == at(5).replace(tzinfo=None)
    assert same(known_trucks(found).drop("newest"), latest_from_readings(df))
    none = latest_from_readings(df.limit(0), with_newest=True)
    assert none.count() == 0
