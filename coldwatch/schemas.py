"""Record layouts: telemetry readings, alerts and the state kept per truck."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire fields of a telemetry reading, in wire order.
TELEMETRY_FIELDS = [
    ("truck_id", "string"),
    ("timestamp", "string"),
    ("route_id", "string"),
    ("latitude", "double"),
    ("longitude", "double"),
    ("speed_kmh", "double"),
    ("heading_degrees", "double"),
    ("gps_accuracy_m", "double"),
    ("temperature_c", "double"),
    ("humidity_pct", "double"),
    ("compressor_status", "string"),
    ("engine_status", "string"),
    ("fuel_level_pct", "double"),
    ("battery_voltage", "double"),
    ("tire_pressure_psi", "double"),
    ("odometer_km", "double"),
    ("door_status", "string"),
    ("cargo_weight_kg", "double"),
    ("status", "string"),
    ("driver_id", "string"),
]

# Older senders report the cargo temperature under this name.
LEGACY_TEMPERATURE = "temperature"

# The two topics, in the order they rank at equal event time.
TELEMETRY_TOPIC = "telemetry"
ALERTS_TOPIC = "alerts"
TOPICS = [TELEMETRY_TOPIC, ALERTS_TOPIC]

# Fields of an alert record, in wire order.
ALERT_RULE_FIELDS = [
    "alert_type",
    "severity",
    "alert_message",
    "action_required",
    "threshold",
    "actual_value",
    "unit",
    "sla_impact",
]
ALERT_CONTEXT_FIELDS = [
    "truck_id",
    "timestamp",
    "latitude",
    "longitude",
    "route_id",
    "driver_id",
    "status",
]
ALERT_FIELDS = ALERT_RULE_FIELDS + ALERT_CONTEXT_FIELDS
PRIMARY_ALERT_FIELDS = ALERT_FIELDS + ["total_alerts", "additional_alerts"]

# What is kept of a truck's last message.
STATE_FIELDS = [
    "last_seen",
    "latitude",
    "longitude",
    "speed_kmh",
    "temperature_c",
    "fuel_level_pct",
    "door_status",
    "status",
    "driver_id",
    "route_id",
]

# Alerts as JSON carries them; threshold and value may be numbers or texts.
_ALERT_TYPES = {
    "latitude": "double",
    "longitude": "double",
    "total_alerts": "int",
    "additional_alerts": "array<string>",
}
ALERT_WIRE_FIELDS = [(name, _ALERT_TYPES.get(name, "string")) for name in PRIMARY_ALERT_FIELDS]

# Every field a message of either topic may have.
MESSAGE_FIELDS = {
    **dict(TELEMETRY_FIELDS),
    LEGACY_TEMPERATURE: "double",
    **dict(ALERT_WIRE_FIELDS),
}

_TYPES = {"string": T.StringType(), "double": T.DoubleType()}


def telemetry_schema(timestamp_type: T.DataType | None = None) -> T.StructType:
    """Telemetry as a table: a sequence number, the event time and the sensor columns."""
    fields = [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", timestamp_type or T.TimestampType()),
    ]
    fields += [
        T.StructField(name, _TYPES[kind]) for name, kind in TELEMETRY_FIELDS if name != "timestamp"
    ]
    fields.append(T.StructField(LEGACY_TEMPERATURE, T.DoubleType()))
    return T.StructType(fields)
