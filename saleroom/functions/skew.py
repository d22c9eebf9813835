"""Ordered, per-key logic over rows that are cut into even parts, whatever their keys.

An ordered window over one key runs in one task. Here all rows are range-partitioned by key
and order, so a hot key's own rows spread over as many parts as it fills; what a part needs to
know about earlier parts of the same key is carried in from a small summary per key and part.
The same plan serves every size and every distribution of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions import cooldown
from saleroom.functions.ids import pinned

PART = "_part"


def in_parts(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows with `_part`, rising with `order` (which must be total), each part sorted.

    The parts are written to the checkpoint folder: a row keeps its part for good, also
    when an executor is lost between two reads.
    """
    return pinned(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(PART, F.spark_partition_id())


def with_last_link(parts: DataFrame, gap: int) -> DataFrame:
    """Adds _last to the first and last key of each part of (_k, _t): the last link before the part, of a chain
    that goes on at each first time more than `gap` after its last link (null at the key's beginning)."""
    kind = dict(parts.dtypes)["_k"]
    states = parts.mapInArrow(cooldown.state_of(gap), cooldown.STATE.format(kind))
    entries = states.groupBy("_k").applyInArrow(cooldown.chained(gap), cooldown.ENTRY.format(kind))
    # at most two rows for each part
    known = F.broadcast(entries.withColumnsRenamed({"_k": "_key", PART: "_at"}))
    here = F.col("_k").eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_at"))
    return parts.join(known, here, "left").drop("_key", "_at")
