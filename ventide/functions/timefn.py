"""Time arithmetic as column expressions (session clock is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def instant(c: Column) -> Column:
    """Zone-less timestamps read as UTC instants; instants are left as they are."""
    return c.cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(instant(c))


def boundary_diff(unit: str, start: Column, end: Column) -> Column:
    """Number of unit boundaries crossed between two instants (00:59 to 01:01 is 1 hour).

    Spark's own timestampdiff counts complete units (0 in that case).
    """
    width = UNIT_SECONDS[unit] * 1_000_000
    return F.floor(micros(end) / F.lit(width)) - F.floor(micros(start) / F.lit(width))


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Exact difference in minutes as a double."""
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def elapsed_whole_hours(start: Column, end: Column) -> Column:
    """Complete hours since `start`: the causal counterpart of boundary_diff('hour')."""
    return F.floor((micros(end) - micros(start)) / F.lit(3_600_000_000))


def hour_bucket(c: Column) -> Column:
    return F.floor(micros(c) / F.lit(3_600_000_000)).cast("long")


def plus_hours(c: Column, hours: int) -> Column:
    return instant(c) + F.make_dt_interval(F.lit(0), F.lit(hours))


def time_chunk(c: Column, seconds: int) -> Column:
    return F.floor(micros(c) / F.lit(seconds * 1_000_000)).cast("long")
