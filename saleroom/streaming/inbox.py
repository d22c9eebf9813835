"""Live inbox, message routing and latest-status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleroom.operators.messaging import conversation_totals
from saleroom.session import configure, scratch_path


def live_inbox(messages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Last message time, message count and unread count per conversation (update mode).

    `reads` is a stream of messages that were unread and have been read since (id,
    conversation_id), each of them once. The aggregation is combined before the shuffle;
    the state is one row per conversation.
    """
    if reads is None:
        return conversation_totals(messages)
    unread = F.coalesce((F.col("is_read") == F.lit(False)) & (F.col("is_from_admin") == F.lit(False)), F.lit(False))
    arrived = messages.select("conversation_id", "sent_at", F.lit(1).alias("_message"), unread.cast("int").alias("_unread"))
    read = reads.select("conversation_id", F.lit(None).cast("timestamp_ntz").alias("sent_at"), F.lit(0).alias("_message"), F.lit(-1).alias("_unread"))
    return arrived.unionByName(read).groupBy("conversation_id").agg(
        F.max("sent_at").alias("last_message_at"), F.sum("_message").alias("message_count"), F.sum("_unread").alias("unread_count")
    )


def last_per_key(changes: DataFrame) -> DataFrame:
    """The newest change per key by (changed_at, id); one row per key is shuffled."""
    last = changes.groupBy("key").agg(F.max(F.struct("changed_at", "id", "status")).alias("_last"))
    return last.select(
        "key", F.col("_last.status").alias("status"), F.col("_last.changed_at").alias("changed_at"),
        F.col("_last.id").alias("id"),
    )


def maintain_status(changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Start the job that keeps the newest status of every key, in its own state.

    The state is the table: nothing else is written, and a change that comes twice, or late,
    leaves the maximum as it is.
    """
    return (
        last_per_key(changes)
        .writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_status(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """key, status, changed_at, id of every key, from the job's state: the newest, or as of a micro-batch."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    state = (reader if batch_id is None else reader.option("batchId", batch_id)).load()
    last = F.col(f"value.`{state.schema['value'].dataType.names[0]}`")
    return state.select(
        F.col("key.key").alias("key"), last["status"].alias("status"), last["changed_at"].alias("changed_at"), last["id"].alias("id")
    )


def replay_status(changes: DataFrame) -> DataFrame:
    """Run the job over the pending changes and return the table."""
    spark = configure(changes.sparkSession)
    checkpoint = scratch_path(spark, "status")
    maintain_status(changes, checkpoint).awaitTermination()
    return read_status(spark, checkpoint)
