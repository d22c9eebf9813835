"""Live intake of JSON records: bounded micro-batches, malformed records kept, input rules applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleroom.operators.quality import check
from saleroom.schemas import TABLES

RECORD = "record"
MALFORMED = "malformed record"
BATCH_BYTES = 1 << 30


def read_records(spark: SparkSession, path: str, table: str, bytes_per_batch: int = BATCH_BYTES) -> DataFrame:
    """A stream of a table's JSON records; one that does not fit the schema keeps its text in `record`.

    A micro-batch takes files up to `bytes_per_batch`, so its size does not depend on how
    the files were cut.
    """
    return (
        spark.readStream.schema(f"{TABLES[table]}, {RECORD} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .option("maxBytesPerTrigger", bytes_per_batch)
        .json(path)
    )


def judged(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `failed` (names of broken rules) and `accepted`; a malformed record is judged as a whole.

    What a malformed record's fields hold depends on where it breaks, so they are emptied.
    """
    broken = F.col(RECORD).isNotNull()
    fields = [c for c in records.columns if c != RECORD]
    checked = check(records, rules)
    return checked.select(
        *(F.when(~broken, F.col(c)).alias(c) for c in fields), RECORD,
        F.when(broken, F.array(F.lit(MALFORMED))).otherwise(F.col("failed")).alias("failed"),
        (~broken & (F.size("failed") == 0)).alias("accepted"),
    )
