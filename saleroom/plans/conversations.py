"""Assigning conversations to a batch of new messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import numbered
from saleroom.operators.messaging import first_conversation


def assign(new: DataFrame, messages: DataFrame) -> DataFrame:
    """Give each new (id, user_id, sent_at) row its `conversation_id`.

    A given non-zero id is kept; else the user's first conversation so far; else a new
    conversation. New ones are numbered after the highest existing id in the order in
    which the users first write. A later message of a new user joins that conversation
    (also when the batch names one for an earlier message of the user).
    """
    has_given = "conversation_id" in new.columns
    given = F.col("conversation_id") if has_given else F.lit(None).cast("bigint")
    rows = new.withColumn("_given", F.nullif(given, F.lit(0)))
    known = first_conversation(messages).withColumnRenamed("conversation_id", "_known")
    rows = rows.drop("conversation_id").join(known, "user_id", "left")

    # one row per new user; the earliest message decides
    first = rows.where(F.col("_known").isNull()).groupBy("user_id").agg(
        F.min(F.struct("sent_at", "id", "_given")).alias("_first")
    ).select("user_id", F.col("_first.sent_at").alias("_at"), F.col("_first._given").alias("_named"))
    unnamed = first.where(F.col("_named").isNull()) if has_given else first
    top = _highest(messages, new)
    opened = numbered(unnamed.select("user_id", "_at"), ["_at", "user_id"], "_n").select(
        "user_id", (top + F.col("_n")).alias("_opened")
    )
    if has_given:
        opened = opened.unionByName(
            first.where(F.col("_named").isNotNull()).select("user_id", F.col("_named").alias("_opened"))
        )
    return (
        rows.join(opened, "user_id", "left")
        .withColumn("conversation_id", F.coalesce("_given", "_known", "_opened"))
        .drop("_given", "_known", "_opened")
    )


def _highest(messages: DataFrame, new: DataFrame):
    """The highest conversation id in the table or named by the batch, as a scalar."""
    ids = messages.select("conversation_id")
    if "conversation_id" in new.columns:
        ids = ids.unionByName(new.select("conversation_id"))
    return ids.agg(F.coalesce(F.max("conversation_id"), F.lit(0)).cast("bigint")).scalar()
