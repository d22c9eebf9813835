"""Running a streaming job over the data that is there, and reading its output.

Used for replays and checks: `availableNow` processes all pending input in bounded
micro-batches and stops. Output and checkpoint go below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.session import configure, scratch_path


def replay(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream into parquet files and return them as a DataFrame."""
    spark = configure(stream.sparkSession)
    out = scratch_path(spark, label)
    job = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def replay_deliveries(deliveries: list[DataFrame], job: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Run an append-mode job once per delivery, each time from its checkpoint, and return all output.

    A delivery is one micro-batch of as many files as it has partitions; the job stops after
    it and starts again for the next, as it would after a failure.
    """
    spark = configure(deliveries[0].sparkSession)
    out = scratch_path(spark, label)
    schema = deliveries[0].schema
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{out}/in")
        stream = job(spark.readStream.schema(schema).parquet(f"{out}/in"))
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option(
            "checkpointLocation", f"{out}/checkpoint"
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def replay_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update-mode stream; return the last version of each key.

    Each micro-batch overwrites its own folder, so a retried batch writes the same
    rows again instead of doubling them.
    """
    spark = configure(stream.sparkSession)
    out = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    job = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    versions = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch_id=*")
    values = [c for c in stream.columns if c not in keys]
    last = versions.groupBy(*keys).agg(
        F.max(F.struct("batch_id", *values)).alias("_last")
    )
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])
