"""Conversations: threads, inbox, routing facts, bulk encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.crypto import decrypted, encrypted
from saleroom.functions.ordering import newest


def _unread() -> Column:
    # both flags must be FALSE; NULL counts as neither
    return (F.col("is_read") == F.lit(False)) & (F.col("is_from_admin") == F.lit(False))


def with_email(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Messages with their sender's e-mail, latest conversation first, oldest message first."""
    emails = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"))
    return messages.join(emails, "user_id").orderBy(newest("conversation_id"), "sent_at", "id")


def participants(messages: DataFrame) -> DataFrame:
    """Distinct (conversation, user) pairs."""
    return messages.select("conversation_id", "user_id").distinct()


def thread_messages(messages: DataFrame, users: DataFrame) -> DataFrame:
    """All messages of the conversations in which any of the given users takes part.

    Two semi-joins: no (user, message) pairs are built, however long a thread is.
    """
    joined = (
        messages.select("conversation_id", "user_id")
        .join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
        .select("conversation_id")
        .distinct()
    )
    return messages.join(joined, "conversation_id", "left_semi").orderBy(
        newest("conversation_id"), "sent_at", "id"
    )


def conversation_totals(messages: DataFrame) -> DataFrame:
    """Last message time, message count and unread count per conversation."""
    return messages.groupBy("conversation_id").agg(
        F.max("sent_at").alias("last_message_at"),
        F.count("*").alias("message_count"),
        F.count_if(_unread()).alias("unread_count"),
    )


def inbox_summary(messages: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per conversation and distinct participant, with whole-conversation counts.

    Messages are aggregated before the join, so a long thread is one row by the time
    it meets its participants. Latest conversation first.
    """
    who = users.select(F.col("id").alias("user_id"), "email")
    extra = [c for c in ("first_name", "last_name", "image_url") if c in profiles.columns]
    faces = profiles.select("user_id", *extra)
    return (
        conversation_totals(messages)
        .join(participants(messages), "conversation_id")
        .join(who, "user_id")
        .join(faces, "user_id", "left")
        .orderBy(newest("last_message_at"), "conversation_id", "user_id")
    )


def next_conversation_id(messages: DataFrame) -> DataFrame:
    return messages.agg(
        (F.coalesce(F.max("conversation_id"), F.lit(0)) + 1).cast("bigint").alias("next_id")
    )


def first_conversation(messages: DataFrame) -> DataFrame:
    """The conversation of each user's earliest message."""
    return messages.groupBy("user_id").agg(
        F.min(F.struct("sent_at", "id", "conversation_id")).alias("_first")
    ).select("user_id", F.col("_first.conversation_id").alias("conversation_id"))


def reply_recipient(messages: DataFrame) -> DataFrame:
    """Whom an admin reply goes to: the sender of the first customer message, per conversation."""
    customer = messages.where(~F.coalesce("is_from_admin", F.lit(False)))
    return customer.groupBy("conversation_id").agg(
        F.min(F.struct("sent_at", "id", "user_id")).alias("_first")
    ).select("conversation_id", F.col("_first.user_id").alias("recipient_id"))


def route(messages: DataFrame, recipients: DataFrame, admin_id: int) -> DataFrame:
    """Who is notified of each message: the admin, or the customer an admin writes to.

    `recipients` comes from `reply_recipient`; an admin message in a conversation
    without a customer falls back to the message's own user. Works on a stream too.
    """
    target = F.when(
        F.coalesce("is_from_admin", F.lit(False)), F.coalesce("recipient_id", "user_id")
    ).otherwise(F.lit(admin_id).cast("bigint"))
    return messages.join(recipients, "conversation_id", "left").withColumn("recipient_id", target)


def encrypt_messages(messages: DataFrame, secret: str) -> DataFrame:
    return messages.withColumn(
        "message_content", encrypted(F.col("message_content"), F.lit(secret), F.col("id"))
    )


def decrypt_messages(messages: DataFrame, secret: str) -> DataFrame:
    """Bulk decryption: `message_content` becomes plain text or NULL, `is_readable` says which."""
    plain = messages.withColumn(
        "message_content", decrypted(F.col("message_content"), F.lit(secret))
    )
    return plain.withColumn("is_readable", F.col("message_content").isNotNull())
