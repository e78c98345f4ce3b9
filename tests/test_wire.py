import json

import pytest

from conftest import SF
from coldwatch.operators.alerts import alerts_primary, alerts_wire
from coldwatch.plans.catalog import catalog
from coldwatch.schemas import TELEMETRY_FIELDS
from coldwatch.sources.kafka import as_messages
from coldwatch.sources.wire import (
    alerts_from_wire,
    decode,
    decode_errors,
    telemetry_from_wire,
    telemetry_to_wire,
    with_wire_problems,
)

FULL = {
    name: "2024-01-09T14:30:00.250Z" if name == "timestamp" else "x" if kind == "string" else 1.5
    for name, kind in TELEMETRY_FIELDS
}

# line, decode status, counted
LINES = [
    (json.dumps(FULL), "ok", True),
    ('{"truck_id": "T"}', "ok", True),
    ('  {"truck_id": "T"}\n', "ok", True),
    ("{}", "ok", True),
    ('{"temperature_c": null}', "ok", True),
    ('{"truck_id": "T", "speed_kmh": "fast"}', "ok", True),
    ('{"speed_kmh": 1, "speed_kmh": 2}', "ok", True),
    ('{"speed_kmh": NaN}', "ok", True),
    ("not json", "malformed", False),
    ("", "malformed", False),
    (None, "malformed", False),
    ('{"truck_id": "T"', "malformed", False),
    ('{"truck_id": "T"} x', "malformed", False),
    ('{"a":1}{"b":2}', "malformed", False),
    ('{"truck_id":"T"}}', "malformed", False),
    ('{"truck_id":"T"}} junk', "malformed", False),
    ('{"truck_id":"A"},"x":{}', "malformed", False),
    ('1,"m":{"truck_id":"EVIL"}', "malformed", False),
    ('{"truck_id":"A"},"m":{"truck_id":"B"}', "malformed", False),
    ("{'truck_id':'T'}", "malformed", False),
    ('{"a":1}],"z":[1', "malformed", False),
    ('{"a":1},"e":2}', "malformed", False),
    ('{"a":1},"e":1}', "malformed", False),
    ("1] x", "malformed", False),
    ("1,2", "malformed", False),
    ('{"a":{"b":1,"b":2},"a":[NaN]}', "ok", True),
    ('[{"a":1,"a":NaN}]', "not_object", True),
    ("[1]", "not_object", True),
    ("3", "not_object", True),
    ('"text"', "not_object", True),
    ("null", "not_object", True),
]


@pytest.fixture
def lines(spark):
    def build(*texts):
        rows = [("telemetry", i, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "topic string, event_id long, value string")

    return build


def test_decode_status(lines):
    decoded = decode(lines(*[text for text, _, _ in LINES]))
    found = decoded.select("event_id", "decode_status", "counted", "failed").collect()
    assert sorted(map(tuple, found)) == [
        (i, status, counted, status != "ok") for i, (_, status, counted) in enumerate(LINES)
    ]
    assert decode_errors(decoded).count() == sum(status != "ok" for _, status, _ in LINES)
    assert telemetry_from_wire(decoded).count() == sum(status == "ok" for _, status, _ in LINES)
    assert telemetry_from_wire(decoded, usable_only=False).count() == len(LINES)


def test_fields(lines):
    texts = [json.dumps(FULL), '{"truck_id": "T", "speed_kmh": "fast", "humidity_pct": 95}']
    full, partial = telemetry_from_wire(decode(lines(*texts))).orderBy("event_id").collect()
    assert {k: full[k] for k in FULL} == FULL
    assert str(full.ts) == "2024-01-09 14:30:00.250000"
    assert (partial.truck_id, partial.speed_kmh, partial.humidity_pct) == ("T", None, 95.0)
    assert partial.ts is None


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-09T14:30:00Z", "2024-01-09 14:30:00"),
        ("2024-01-09T14:30:00.123456", "2024-01-09 14:30:00.123456"),
        ("2024-01-09T14:30:00+02:00", None),
        ("soon", None),
        ("", None),
    ],
)
def test_times(lines, text, expected):
    ts = telemetry_from_wire(decode(lines(json.dumps({"timestamp": text})))).first().ts
    assert (None if ts is None else str(ts)) == expected


def test_legacy_temperature_fires(lines):
    readings = telemetry_from_wire(decode(lines('{"temperature": 3.5, "truck_id": "T"}')))
    assert alerts_primary(readings).first().alert_type == "TEMP_BREACH"


def test_wire_problems(lines):
    numeric_id = {**FULL, "truck_id": 7, "speed_kmh": "fast"}
    less = {k: v for k, v in FULL.items() if k != "door_status"}
    decoded = decode(lines(json.dumps(FULL), json.dumps(numeric_id), json.dumps(less)))
    rows = with_wire_problems(decoded).orderBy("event_id").collect()
    assert [r.problems for r in rows] == [[], ["truck_id", "speed_kmh"], ["door_status"]]


def test_wire_problems_of_odd_but_complete_readings(lines):
    text = json.dumps(FULL)
    repeated, nan = '{"speed_kmh": 1, ' + text[1:], '{"x": NaN, "y": {"z": 1, "z": 2}, ' + text[1:]
    listed = text.replace('"truck_id": "x"', '"truck_id": ["x"]')
    decoded = decode(lines(text, repeated, nan, listed, text.replace('"x"', "NaN")))
    rows = with_wire_problems(decoded).orderBy("event_id").collect()
    texts = [name for name, kind in TELEMETRY_FIELDS if kind == "string" and name != "timestamp"]
    assert [r.problems for r in rows] == [[], [], [], ["truck_id"], texts]


@pytest.fixture
def new_york(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_times_do_not_depend_on_the_session_zone(lines, new_york):
    hot = {"truck_id": "T", "temperature_c": 3.5}
    times = ["2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "2024-03-10T07:30:00.25Z"]
    readings = telemetry_from_wire(decode(lines(*[json.dumps({**hot, "timestamp": t}) for t in times])))
    found = alerts_wire(alerts_primary(readings)).orderBy("event_id").collect()
    assert [json.loads(r.value)["timestamp"] for r in found] == [
        "2024-11-03T05:30:00.000000Z", "2024-11-03T06:30:00.000000Z", "2024-03-10T07:30:00.250000Z"
    ]


def test_fleet_of_the_wire_in_another_zone(spark, request):
    query = catalog()["fleet_state_wire"]
    names = [c for c in query(spark, SF).columns]
    want = sorted(map(str, query(spark, SF).select(names).collect()))
    request.getfixturevalue("new_york")
    assert sorted(map(str, query(spark, SF).select(names).collect())) == want


def test_telemetry_round_trip(telemetry):
    back = telemetry_from_wire(decode(telemetry_to_wire(telemetry)))
    names = [c for c in telemetry.columns if c != "ts"]
    assert back.select(names).exceptAll(telemetry.select(names)).count() == 0
    assert back.count() == telemetry.count()


def test_alert_round_trip(telemetry):
    alerts = alerts_primary(telemetry)
    wire = alerts_wire(alerts)
    one = json.loads(wire.where("value LIKE '%COMPRESSOR_FAULT%'").first().value)
    assert set(one) >= {"alert_type", "severity", "threshold", "actual_value", "timestamp"}
    numbers = [json.loads(r.value) for r in wire.where("value LIKE '%\"LOW_FUEL\",\"sev%'").collect()]
    assert all(a["threshold"] == 15.0 and isinstance(a["actual_value"], float) for a in numbers)
    back = alerts_from_wire(decode(wire))
    names = [c for c in alerts.columns if c != "timestamp"]
    assert back.select(names).exceptAll(alerts.select(names)).count() == 0


def test_kafka_records(spark):
    rows = [(bytearray(b"T"), bytearray(b'{"truck_id":"T"}'), "telemetry", 0, 42, None, 0)]
    schema = (
        "key binary, value binary, topic string, partition int, offset long,"
        " timestamp timestamp, timestampType int"
    )
    message = as_messages(spark.createDataFrame(rows, schema)).first()
    assert (message.key, message.value, message.event_id) == ("T", '{"truck_id":"T"}', 42)
