"""Consecutive ids for new rows, in a stated order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleroom.session import ensure_checkpoint_dir


def pinned(rows: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder: computed once, safe to read many times."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """Add `name` = 1, 2, 3, … following `order` (which must be total).

    The rows are range-partitioned and sorted once, then written to the checkpoint
    folder: that pins each row to its partition, so the two reads below (partition
    sizes, then the rows) agree even if an executor is lost between them.
    """
    fixed = (
        pinned(rows.sort(*order))
        .withColumn("_part", F.spark_partition_id())
        # partition number in the high bits, row position in the low 33 bits
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per partition: small by construction
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def next_id(table: DataFrame, column: str = "id") -> Column:
    """The highest id so far (0 for an empty table), as a scalar subquery."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).scalar()


def with_new_ids(
    rows: DataFrame, table: DataFrame, order: list[str | Column], name: str = "id"
) -> DataFrame:
    """Give new rows the ids that follow the table's highest one."""
    numbers = numbered(rows, order, "_n")
    return numbers.withColumn(name, next_id(table) + F.col("_n")).drop("_n")
