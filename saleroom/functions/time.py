"""Zone-less timestamp helpers. Time is always a parameter, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: str | dt.datetime) -> Column:
    """A literal zone-less timestamp."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def interval(unit: str, n: int) -> Column:
    """`interval('MINUTE', 5)`."""
    return F.expr(f"INTERVAL '{int(n)}' {unit}")


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from `start` to `end` (negative when `end` is earlier)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def epoch_micros(ts: Column) -> Column:
    return micros_between(ntz("1970-01-01 00:00:00"), ts)
