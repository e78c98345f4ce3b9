"""Event-time helpers that work on TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def parse_utc(text: Column) -> Column:
    """ISO text to an instant, NULL if unreadable.

    Senders write UTC with a trailing ``Z``; text without a zone is UTC too,
    whatever the session zone. Text carrying an offset is not accepted.
    """
    return F.try_to_timestamp(F.concat(F.rtrim(text, F.lit("Z")), F.lit("Z")))


def utc_clock(ts: Column) -> Column:
    """What a clock in UTC shows, as TIMESTAMP_NTZ, whatever the session zone.

    An instant is counted from the epoch; a TIMESTAMP_NTZ is UTC already.
    """
    seconds = (F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("decimal(18,6)")
    none = F.lit(0)
    shown = _epoch() + F.make_dt_interval(none, none, none, seconds)
    return F.when(F.typeof(ts) == "timestamp_ntz", ts.cast("timestamp_ntz")).otherwise(shown)


def utc_instant(clock: Column) -> Column:
    """The instant at which a clock in UTC shows a TIMESTAMP_NTZ."""
    seconds = (clock - _epoch()).cast("interval second").cast("decimal(20,6)")
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def iso_utc(ts: Column) -> Column:
    """The wire form of an event time."""
    return F.date_format(utc_clock(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Exact seconds between two event times, to the microsecond."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def not_older_than(ts: Column, as_of: Column, max_age_seconds: float) -> Column:
    """True while ``as_of - ts`` is within the age; a missing time never ages."""
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(max_age_seconds)))
    return ts.isNull() | (ts >= as_of - age)
