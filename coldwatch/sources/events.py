"""Telemetry projected from the generic ``events`` table.

The projection stands in for recorded telemetry: every sensor column is an
arithmetic function of the event, chosen so that all rules, both severities,
threshold values, silent sensors and unknown trucks occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.schemas import TELEMETRY_TOPIC
from coldwatch.sources.wire import telemetry_json

# id, u and k are bigint; the last is the number inside props.
_COLUMNS = {
    "truck_id": "CASE WHEN id % 109 = 0 THEN NULL ELSE concat('TRUCK-', CAST(101 + u AS STRING)) END",
    "route_id": "CASE u % 3 WHEN 0 THEN 'RT-LAG-ABJ' WHEN 1 THEN 'RT-PHC-MKD' ELSE 'RT-BEN-ABJ' END",
    "latitude": "4 + CAST((id * 97 + k * 3) % 6000 AS DOUBLE) / 1000",
    "longitude": "3 + CAST((id * 89 + k * 5) % 5000 AS DOUBLE) / 1000",
    "speed_kmh": "CASE WHEN id % 103 = 0 THEN NULL ELSE CAST((id * 71 + k * 13) % 1050 AS DOUBLE) / 10 END",
    "heading_degrees": "CAST((id * 31) % 3600 AS DOUBLE) / 10",
    "gps_accuracy_m": "CAST(k % 61 + 20 AS DOUBLE) / 10",
    "temperature_c": "CASE WHEN id % 97 = 0 THEN NULL ELSE CAST((id * 37 + k * 11) % 190 - 230 AS DOUBLE) / 10 END",
    "humidity_pct": "CAST((id * 53 + k * 7) % 320 + 600 AS DOUBLE) / 10",
    "compressor_status": "CASE WHEN event_type = 'error' AND k >= 80 THEN 'FAULT' ELSE 'ON' END",
    "engine_status": "'RUNNING'",
    "fuel_level_pct": "CAST((id * 29 + k * 17) % 960 + 40 AS DOUBLE) / 10",
    "battery_voltage": "CAST((id * 43 + k * 19) % 300 + 1160 AS DOUBLE) / 100",
    "tire_pressure_psi": "CAST((id * 61 + k * 23) % 200 + CASE WHEN id % 8 = 0 THEN 680 ELSE 1000 END AS DOUBLE) / 10",
    "odometer_km": "50000 + CAST(id AS DOUBLE) / 10",
    "door_status": "CASE WHEN id % 101 = 0 THEN NULL WHEN event_type = 'signup' AND k < 30 THEN 'OPEN' ELSE 'CLOSED' END",
    "cargo_weight_kg": "8000 + value",
    "status": "CASE (id + k) % 10 WHEN 0 THEN 'LOADING' WHEN 1 THEN 'DOCKED' ELSE 'IN_TRANSIT' END",
    "driver_id": "CASE WHEN id % 107 = 0 THEN NULL ELSE concat('DRV-00', CAST(u % 5 + 1 AS STRING)) END",
    "temperature": "CASE WHEN id % 194 = 0 THEN CAST(k - 60 AS DOUBLE) / 2 END",
}


def events_path(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


def telemetry_from_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The telemetry table; works on a stream of events too."""
    keyed = events.select(
        "*",
        F.col("event_id").alias("id"),
        F.col("user_id").alias("u"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )
    return keyed.selectExpr(
        "event_id", "ts", *[f"{sql} AS {name}" for name, sql in _COLUMNS.items()], *keep
    )


def read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from_events(spark.read.parquet(events_path(sf_dir)))


def stream_telemetry(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Telemetry from a growing set of event files.

    ``path`` may be a glob, and is turned into one: a file stream takes folders
    and globs, but not the name of a single file.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    glob = path if any(c in path for c in "*?[{") else f"{folder}/[{name[0]}]{name[1:]}"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return telemetry_from_events(reader.parquet(glob))


def wire_from_events(events: DataFrame) -> DataFrame:
    """The telemetry topic as JSON text, with some events sent as bad messages."""
    telemetry = telemetry_from_events(events, keep=("props",))
    number = F.regexp_extract("props", "([0-9]+)", 1)
    every = F.col("event_id")
    reading = F.substring(telemetry_json(), 2, 1 << 20)
    value = (
        F.when(every % 127 == 0, F.lit(None).cast("string"))
        .when(every % 113 == 0, F.substring("props", F.lit(1), F.length("props") - 1))
        .when(every % 139 == 0, F.concat("props", F.lit(" x")))
        .when(every % 131 == 0, F.concat(F.lit("["), number, F.lit("]")))
        .when(every % 137 == 0, number)
        .when(every % 149 == 0, F.concat("props", F.lit("}")))
        .when(every % 151 == 0, F.concat("props", F.lit(',"x":{}')))
        .when(every % 157 == 0, F.translate("props", '"', "'"))
        .when(every % 163 == 0, F.concat(number, F.lit(',"m":{"truck_id":"EVIL"}')))
        # Complete readings with a repeated key, and with NaN in an unknown field.
        .when(every % 167 == 0, F.concat(F.lit('{"x":1,"x":2,'), reading))
        .when(every % 173 == 0, F.concat(F.lit('{"x":NaN,'), reading))
        .otherwise(telemetry_json())
    )
    return telemetry.select(
        F.lit(TELEMETRY_TOPIC).alias("topic"),
        "event_id",
        F.col("truck_id").alias("key"),
        value.alias("value"),
    )


def read_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire_from_events(spark.read.parquet(events_path(sf_dir)))
