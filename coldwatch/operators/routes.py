"""The route dimension, its segments, and the route of a truck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldwatch.functions.geo import compass_heading, haversine_km

# Fixed values: (route id, name, waypoints as latitude, longitude, road type, place).
ROUTES = [
    ("RT-LAG-ABJ", "Lagos to Abuja Express", [
        (6.4550, 3.3941, "urban", "Lagos Mainland"),
        (6.5962, 3.3683, "urban", "Ikeja"),
        (6.8256, 3.6472, "highway", "Ikorodu"),
        (6.8926, 3.7196, "highway", "Sagamu Junction"),
        (7.3768, 3.9398, "urban", "Ibadan"),
        (7.7027, 4.4984, "highway", "Oshogbo"),
        (8.4904, 4.5522, "urban", "Ilorin"),
        (8.8500, 5.9667, "highway", "Mokwa"),
        (9.0563, 7.4985, "urban", "Abuja FCT"),
    ]),
    ("RT-PHC-MKD", "Port Harcourt to Makurdi", [
        (4.8156, 7.0498, "urban", "Port Harcourt"),
        (5.1117, 7.3678, "highway", "Elele"),
        (5.4851, 7.0354, "urban", "Owerri"),
        (6.0072, 7.1194, "highway", "Okigwe"),
        (6.4584, 7.5464, "urban", "Enugu"),
        (6.8833, 7.3833, "highway", "Nsukka"),
        (7.7322, 8.5218, "urban", "Makurdi"),
    ]),
    ("RT-BEN-ABJ", "Benin to Abuja", [
        (6.3392, 5.6175, "urban", "Benin City"),
        (6.7428, 6.0922, "highway", "Ekpoma"),
        (7.1706, 6.1360, "urban", "Auchi"),
        (7.5629, 6.2343, "highway", "Okene"),
        (8.0069, 6.7455, "urban", "Lokoja"),
        (8.5000, 7.1500, "highway", "Abaji"),
        (9.0600, 7.4800, "urban", "Abuja"),
    ]),
]

# Speed range in km/h per road type, and for any other type.
ROAD_SPEEDS = {"highway": (70.0, 100.0), "urban": (25.0, 45.0), "loading_zone": (0.0, 5.0)}
OTHER_ROAD_SPEED = (40.0, 60.0)


def routes(spark: SparkSession) -> DataFrame:
    """Route dimension with nested waypoints; the first route is the fallback."""
    rows = [
        F.struct(
            F.lit(position).alias("route_pos"),
            F.lit(route_id).alias("route_id"),
            F.lit(name).alias("route_name"),
            F.array(
                *[
                    F.struct(
                        F.lit(lat).alias("latitude"),
                        F.lit(lon).alias("longitude"),
                        F.lit(road).alias("road_type"),
                        F.lit(place).alias("name"),
                    )
                    for lat, lon, road, place in waypoints
                ]
            ).alias("waypoints"),
        )
        for position, (route_id, name, waypoints) in enumerate(ROUTES)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def road_speed(road_type: Column, bound: int) -> Column:
    """Lower (0) or upper (1) end of the usual speed on a type of road."""
    speed = None
    for road, limits in ROAD_SPEEDS.items():
        here = road_type == road
        value = F.lit(limits[bound])
        speed = F.when(here, value) if speed is None else speed.when(here, value)
    return speed.otherwise(F.lit(OTHER_ROAD_SPEED[bound]))


def route_segments(route_table: DataFrame) -> DataFrame:
    """Each waypoint with the next one; the last leads back to the first.

    A segment has the road type and speed range of the waypoint it starts at.
    """
    points = route_table.select(
        "route_id", F.posexplode("waypoints").alias("segment", "start")
    )
    along = Window.partitionBy("route_id").orderBy("segment")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.coalesce(F.lead("start").over(along), F.first("start").over(whole))
    paired = points.withColumn("end", end)
    at = [F.col(f"{p}.{c}") for p in ("start", "end") for c in ("latitude", "longitude")]
    return paired.select(
        "route_id",
        "segment",
        F.col("start.name").alias("start_name"),
        F.col("end.name").alias("end_name"),
        F.col("start.road_type").alias("road_type"),
        haversine_km(*at).alias("distance_km"),
        compass_heading(*at).alias("heading_degrees"),
        road_speed(F.col("start.road_type"), 0).alias("min_speed_kmh"),
        road_speed(F.col("start.road_type"), 1).alias("max_speed_kmh"),
    )


def truck_route(trucks: DataFrame, route_table: DataFrame) -> DataFrame:
    """The route each truck is on; an unknown route id means the first route of the table.

    ``trucks`` has ``truck_id`` and ``route_id``. The dimension is the handful
    of rows of ``routes``, so it is broadcast. Without any route, there is none to fall back to.
    """
    dimension = route_table.select(
        F.col("route_id").alias("known_id"), "route_name", F.size("waypoints").alias("waypoints")
    )
    own = F.struct("route_id", "route_name", F.size("waypoints").alias("waypoints"))
    first = route_table.agg(F.min_by(own, "route_pos")).scalar()
    joined = trucks.join(
        F.broadcast(dimension), F.col("route_id") == F.col("known_id"), "left"
    )
    return joined.select(
        "truck_id",
        F.col("route_id").alias("reported_route_id"),
        F.coalesce("known_id", first["route_id"]).alias("route_id"),
        F.coalesce("route_name", first["route_name"]).alias("route_name"),
        F.coalesce("waypoints", first["waypoints"]).alias("waypoints"),
    )


def truck_segments(assigned: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments each truck drives, from ``truck_route`` and ``route_segments``.

    The segments of all routes are a fixed small table and are broadcast.
    """
    return assigned.select("truck_id", "route_id").join(F.broadcast(segments), "route_id")
