"""Stored tables of which a change rewrites only the partitions it touches.

A table is a folder of plain Spark partitions: by day, where rows go out of date by day, and
by a hash of the id elsewhere. A change names the rows it is about; their partitions are read
(partition pruning), changed and written back with Spark's dynamic partition overwrite, which
stages the new files and then swaps the folders it has rows for. A partition whose rows all go
is dropped as a folder. Inserts add files and rewrite nothing.

Repeating a change does no harm: updates set values, deletes find nothing left. A table has
one writer at a time; readers that list a table while a change is swapped in may see some of
its partitions before and some after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from saleroom.schemas import TABLES

# Tables in one folder per day of a timestamp; all others are spread over hashed ids.
DAYS = {"notifications": "created_at"}
PARTS = 64
PART, DAY = "_part", "_day"


@dataclass(frozen=True)
class Done:
    """What a change did: partitions rewritten and dropped, rows it wrote and rows it took away."""

    rewritten: int
    dropped: int
    written: int
    removed: int


class PartitionedTables:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _place(self, table: str) -> tuple[str, Column]:
        if table in DAYS:
            return DAY, F.col(DAYS[table]).cast("date")
        return PART, F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")

    def _stored(self, table: str) -> DataFrame:
        """The table with its partition column; an empty one if nothing is stored yet."""
        name, _ = self._place(table)
        shape = f"{TABLES[table]}, {name} {'DATE' if table in DAYS else 'INT'}"
        try:
            return self.spark.read.schema(shape).parquet(self.path(table))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], shape)

    def read(self, table: str) -> DataFrame:
        return self._stored(table).drop(PART, DAY)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows. They are dealt to their partitions first, so a partition gets few files."""
        name, place = self._place(table)
        placed = rows.withColumn(name, place)
        placed.repartition(name).write.partitionBy(name).mode("append").parquet(self.path(table))

    def _parts(self, rows: DataFrame, name: str) -> list[object]:
        """The partitions that rows lie in: at most as many as the table has."""
        return [r[0] for r in rows.select(name).distinct().collect()]

    def parts_of(self, table: str, ids: DataFrame) -> list[object]:
        """The partitions of ids, found without reading the table (for tables spread by id)."""
        return self._parts(ids.toDF("id").select(self._place(table)[1].alias(PART)), PART)

    def parts_where(self, table: str, condition: Column) -> list[object]:
        """The partitions that hold rows of a condition: reads its columns only."""
        return self._parts(self._stored(table).where(condition), self._place(table)[0])

    def change(self, table: str, parts: list[object], plan: Callable[[DataFrame], DataFrame]) -> Done:
        """Apply `plan` (updates and deletes; rows keep their place) to the partitions named."""
        if not parts:
            return Done(0, 0, 0, 0)
        name, _ = self._place(table)
        known = [p for p in parts if p is not None]
        here = F.col(name).isin(known) if known else F.lit(False)
        if len(known) < len(parts):  # rows without a day have a folder of their own
            here = here | F.col(name).isNull()
        before, after = Observation(), Observation()
        old = self._stored(table).where(here).observe(before, F.count(F.lit(1)).alias("n"))
        new = plan(old).observe(after, F.count(F.lit(1)).alias("n"), F.collect_set(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("parts"))
        new.write.partitionBy(name).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(table))
        left = set(after.get["parts"])
        gone = [p for p in parts if ("" if p is None else str(p)) not in left]
        for p in gone:
            self.drop(table, p)
        return Done(len(parts) - len(gone), len(gone), after.get["n"], before.get["n"] - after.get["n"])

    def drop(self, table: str, part: object) -> None:
        """Delete a partition's folder, unread."""
        value = "__HIVE_DEFAULT_PARTITION__" if part is None else str(part)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{self._place(table)[0]}={value}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def days(self, table: str) -> list[object]:
        """The days that a table has folders for: read from the folders' names alone."""
        return sorted(d for d in self._parts(self._stored(table), DAY) if d is not None)
