"""When trucks had an active alert: from an alert until none has followed for a while.

An alert stays active for some seconds and every further one prolongs it, so the active
intervals of a truck are sessions of its alerts. On a stream an interval is given out when
the watermark passes its end: the expiry of the truck's alert is an event of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.operators.fleet import DEFAULT_MAX_AGE_SECONDS


def alert_intervals(
    alerts: DataFrame,
    max_age_seconds: int = DEFAULT_MAX_AGE_SECONDS,
    late: str | None = None,
) -> DataFrame:
    """Per truck the intervals in which it had an active alert.

    ``active_until`` is ``max_age_seconds`` after the last alert. With ``late``, how much later
    than newer ones an alert may come in, a stream gives each interval once it is over; its
    ``timestamp`` must be an instant then.
    Alerts that are later still are left out. Alerts without truck or time belong to none.
    Partial sessions are merged in the map tasks, so a hot truck is not gathered row by row.
    """
    known = alerts.where(
        F.col("truck_id").isNotNull() & (F.col("truck_id") != "") & F.col("timestamp").isNotNull()
    )
    if late is not None:
        known = known.withWatermark("timestamp", late)
    # Sessions that touch are one, as an alert is active until the very end of its time.
    gap = f"{max_age_seconds} seconds"
    lasted = F.make_dt_interval(secs=F.lit(max_age_seconds).cast("decimal(18,6)"))
    found = known.groupBy("truck_id", F.session_window("timestamp", gap)).agg(
        F.min("timestamp").alias("active_from"),
        F.max("timestamp").alias("last_alert"),
        F.count("*").alias("alerts"),
    )
    return found.select(
        "truck_id", "active_from", "last_alert", (F.col("last_alert") + lasted).alias("active_until"),
        "alerts",
    )
