"""What trucks drove: consecutive GPS fixes, distance and fuel per truck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldwatch.functions.geo import compass_heading, haversine_km
from coldwatch.functions.time import elapsed_seconds

# Litres per kilometre and litres in a full tank.
FUEL_LITRES_PER_KM = 0.3
TANK_LITRES = 400

# Readings that one task is to sort; there are as many pieces as that takes.
PIECE_READINGS = 4_000_000

_FIX = ["truck_id", "ts", "event_id", "latitude", "longitude", "speed_kmh"]
_TIMELINE = ["ts", "event_id"]


_CARRIED = ["ts", "latitude", "longitude"]


def _previous(window: Window) -> dict[str, Column]:
    """The previous reading's columns; ``has_previous`` tells it from missing values."""
    lagged = {f"previous_{name}": F.lag(name).over(window) for name in _CARRIED}
    lagged["has_previous"] = F.lag(F.lit(True), 1, False).over(window)
    return lagged


def _paired(fixes: DataFrame, pieces: int) -> DataFrame:
    """Each reading with its truck's previous one.

    Range partitioning on (truck, time, sequence) cuts the timelines into
    contiguous pieces of similar size, whatever the distribution, even if all
    readings are of one truck and share one timestamp. Inside a piece ``lag`` finds the
    previous reading. Only the first reading of a truck in a piece lacks one: it is the last of
    the piece before. So the two ends of every piece, at most two rows per piece
    and truck, meet in one group in a second window. Interior rows keep their
    piece as the group, so no group outgrows a piece.

    The piece number is data from here on, in a single line of operators. It is
    never computed twice, so it cannot disagree with itself after a task is lost.
    """
    numbered = fixes.repartitionByRange(pieces, "truck_id", *_TIMELINE).withColumn(
        "piece", F.spark_partition_id()
    )
    inside = Window.partitionBy("truck_id", "piece").orderBy(*_TIMELINE)
    paired = numbered.withColumns(
        {**_previous(inside), "has_next": F.lead(F.lit(True), 1, False).over(inside)}
    )
    interior = F.col("has_previous") & F.col("has_next")
    grouped = paired.withColumn("group", F.when(interior, F.col("piece")).otherwise(F.lit(-1)))
    across = _previous(Window.partitionBy("truck_id", "group").orderBy(*_TIMELINE))
    stitched = {
        name: F.when(F.col("has_previous"), F.col(name)).otherwise(found)
        for name, found in across.items()
    }
    return grouped.withColumns(stitched).drop("piece", "has_next", "group")


def pieces_for(fixes: DataFrame, piece_readings: int = PIECE_READINGS) -> int:
    """As many pieces as the number of readings takes, and one per core at least."""
    needed = -(-fixes.count() // piece_readings)
    return max(needed, fixes.sparkSession.sparkContext.defaultParallelism)


def consecutive_fixes(telemetry: DataFrame, pieces: int | None = None) -> DataFrame:
    """Each reading of a known truck with that truck's previous one, if any.

    Counts the readings first, unless the number of ``pieces`` is given.
    """
    fixes = telemetry.where(F.col("truck_id").isNotNull() & (F.col("truck_id") != "")).select(
        *_FIX
    )
    return _paired(fixes, pieces_for(fixes) if pieces is None else pieces)


def trip_segments(fixes: DataFrame) -> DataFrame:
    """Distance, heading and time between consecutive readings of a truck."""
    at = [F.col(c) for c in ("previous_latitude", "previous_longitude", "latitude", "longitude")]
    return fixes.where("has_previous").select(
        "truck_id",
        "event_id",
        F.col("previous_ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        elapsed_seconds(F.col("previous_ts"), F.col("ts")).alias("elapsed_s"),
        haversine_km(*at).alias("distance_km"),
        compass_heading(*at).alias("heading_degrees"),
    )


def trip_summary(fixes: DataFrame) -> DataFrame:
    """Time, kilometres and fuel per truck, from speed over elapsed time.

    The sums are decimal, hence the same for any partitioning.
    """
    elapsed = F.coalesce(elapsed_seconds(F.col("previous_ts"), F.col("ts")), F.lit(0.0))
    km = F.coalesce(F.col("speed_kmh"), F.lit(0.0)) / 3600 * elapsed
    driven = fixes.select(
        "truck_id",
        elapsed.cast("decimal(28,6)").alias("elapsed"),
        km.cast("decimal(28,9)").alias("km"),
    )
    total_km = F.sum("km").cast("double")
    return driven.groupBy("truck_id").agg(
        F.count("*").alias("readings"),
        F.sum("elapsed").cast("double").alias("elapsed_s"),
        total_km.alias("distance_km"),
        (total_km * FUEL_LITRES_PER_KM / TANK_LITRES * 100).alias("fuel_used_pct"),
    )
