"""The alert history: the newest alerts, and filters within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size of the history, and of the list shown for one truck.
HISTORY_SIZE = 100
DEFAULT_RECENT = 50
RECENT_PER_TRUCK = 10


def _newest_first(alerts: DataFrame) -> list[Column]:
    """A total order. A sequence number may repeat where it is an offset: in another
    partition, which the truck decides, or for alerts without a truck, the partition."""
    ties = ["event_id", "truck_id", "partition", "alert_type"]
    return [F.col(c).desc() for c in ("timestamp", *ties) if c in alerts.columns]


def alert_history(alerts: DataFrame, size: int = HISTORY_SIZE) -> DataFrame:
    """The newest alerts of the whole fleet, newest first.

    A top-k: each task keeps ``size`` rows, nothing is sorted globally.
    """
    return alerts.orderBy(*_newest_first(alerts)).limit(size)


def alerts_recent(
    history: DataFrame,
    limit: int = DEFAULT_RECENT,
    severity: str | None = None,
    alert_type: str | None = None,
) -> DataFrame:
    """Filter and cut the history. Filters look inside the history only, so an
    alert that has left it is not found however few match."""
    if not 1 <= limit <= HISTORY_SIZE:
        raise ValueError(f"limit must be between 1 and {HISTORY_SIZE}")
    found = history
    if severity:
        found = found.where(F.col("severity") == F.upper(F.lit(severity)))
    if alert_type:
        found = found.where(F.col("alert_type") == F.upper(F.lit(alert_type)))
    return found.orderBy(*_newest_first(found)).limit(limit)


def truck_recent_alerts(
    history: DataFrame, truck_id: str | None = None, size: int = RECENT_PER_TRUCK
) -> DataFrame:
    """The newest alerts of one truck, or of every truck, within the history.

    The window runs over the history, which has at most ``HISTORY_SIZE`` rows.
    """
    found = history.where(F.col("truck_id").isNotNull())
    if truck_id is not None:
        found = found.where(F.col("truck_id") == truck_id)
    by_truck = Window.partitionBy("truck_id").orderBy(*_newest_first(found))
    return found.withColumn("recency", F.row_number().over(by_truck)).where(
        F.col("recency") <= size
    )
