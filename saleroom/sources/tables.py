"""Typed scans of the marketplace tables and live intake of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saleroom.schemas import TABLES


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A full scan with the declared schema: no inference, columns pruned by the plan."""
    return spark.read.schema(TABLES[table]).format(fmt).load(path)


def read_stream(
    spark: SparkSession, path: str, table: str, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """New rows of a table as they arrive; the file count bounds a micro-batch."""
    return (
        spark.readStream.schema(TABLES[table])
        .format(fmt)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
