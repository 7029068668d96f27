"""Intervals and epochs as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(interval: Column) -> Column:
    """A day-time interval in seconds, as a double."""
    part = lambda name: F.extract(F.lit(name), interval)
    return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("double")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a time, as a double; times without a zone are UTC."""
    return seconds(ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def lock_key(a: Column, b: Column) -> Column:
    """One 64-bit number for a pair of names, in which their order counts."""
    return F.xxhash64(a, F.lit(0)).bitwiseXOR(F.xxhash64(b, F.lit(1)))
