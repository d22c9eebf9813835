"""Output formats: the inventory CSV, JSON rows, the error log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleroom.functions.time import ntz
from saleroom.schemas import ERRORS


def write_inventory_csv(sheet: DataFrame, path: str, single_file: bool = False) -> None:
    """The export with a header and every value quoted; NULL is written as an empty string.

    `single_file` is for sheets known to be small: it writes through one task.
    """
    if single_file:
        sheet = sheet.coalesce(1)
    (
        sheet.write.mode("errorifexists")
        .option("header", True)
        .option("quoteAll", True)
        .option("nullValue", "")
        .option("escape", '"')
        .csv(path)
    )


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON text per line, from the `json` column."""
    rows.select("json").write.mode("errorifexists").text(path)


def log_error(spark: SparkSession, path: str, error: str, context: str, at: str, error_id: int) -> None:
    """Append one job error."""
    row = spark.range(1).select(
        F.lit(error_id).cast("bigint").alias("id"), ntz(at).alias("created_at"),
        F.lit(error).alias("error"), F.lit(context).alias("context"),
    )
    row.write.mode("append").parquet(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ERRORS).parquet(path)
