"""Orderings with the NULL placement of the original store: DESC first, ASC last."""

from __future__ import annotations

# Every global sort below ends with an id: the order is then total, and a range
# partition never has to hold all rows that share one timestamp.

from pyspark.sql import Column
from pyspark.sql import functions as F


def newest(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def oldest(name: str) -> Column:
    return F.col(name).asc_nulls_last()
