"""Timestamps without zone, lags and their microseconds.

Every job takes an explicit ``as_of`` instead of reading a wall clock, so that a rerun gives the
same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = str | datetime | Column


def as_of_column(as_of: AsOf) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp (the session runs in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    return epoch_micros(end) - epoch_micros(start)


def interval_micros(interval: Column) -> Column:
    """Length of a day-time interval in microseconds, as a BIGINT."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch_micros(origin + interval)
