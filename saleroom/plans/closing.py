"""Closing auctions: the expiry sweep and buy-now purchases.

Both are pure functions of the tables at `as_of` and return every output together,
so results, notifications and messages come from one consistent snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.functions.time import ntz
from saleroom.operators.auctions import expired, top_bid
from saleroom.plans.conversations import assign

WIN_TEXT = "*system message*\n\nYou won the auction. Your account page shows the total and how to pay."


@dataclass
class Closing:
    """What a close produces. `auctions` is the next version, the rest are new rows."""

    auctions: DataFrame
    results: DataFrame
    notifications: DataFrame | None
    messages: DataFrame
    bids: DataFrame | None = None


def win_messages(
    results: DataFrame, messages: DataFrame, as_of: str, text: str, into: DataFrame | None = None
) -> DataFrame:
    """A system message per win, into the winner's first conversation or a new one.

    `into` (user_id, conversation_id) overrides the choice of an existing one. A winner
    of several auctions opens at most one new conversation.
    """
    notes = results.where(F.col("winner_id").isNotNull()).select(
        F.col("auction_id").alias("id"), F.col("winner_id").alias("user_id"),
        ntz(as_of).alias("sent_at"),
    )
    if into is not None:
        notes = notes.join(into, "user_id", "left")
    placed = assign(notes, messages)
    return placed.select(
        F.col("id").alias("auction_id"), "conversation_id", "user_id",
        F.lit(text).alias("message_content"), "sent_at",
        F.lit(False).alias("is_read"), F.lit(True).alias("is_from_admin"),
    )


def deactivate(auctions: DataFrame, closed: DataFrame, as_of: str) -> DataFrame:
    """The auctions with the closed ones (auction_id) made inactive."""
    marks = closed.select(F.col("auction_id").alias("id"), F.lit(True).alias("_closed"))
    values = {"is_active": F.lit(False), "updated_at": ntz(as_of)}
    closed_now = F.coalesce("_closed", F.lit(False))
    joined = auctions.join(marks, "id", "left")
    return joined.select(*[
        (F.when(closed_now, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c)
        for c in auctions.columns
    ])


def due_auctions(auctions: DataFrame, results: DataFrame | None, as_of: str) -> DataFrame:
    """Ids (auction_id) of the auctions to close: active, past their end, without a result."""
    due = expired(auctions, as_of).select(F.col("id").alias("auction_id"))
    if results is not None:
        due = due.join(results.select("auction_id"), "auction_id", "left_anti")
    return due


def expired_results(
    auctions: DataFrame, bids: DataFrame, results: DataFrame | None, as_of: str
) -> DataFrame:
    """Result rows of the auctions that end now: winner and price, or NULLs without bids.

    Auctions that already have a result are left alone, so a repeated run adds nothing.
    """
    best = top_bid(bids).select(
        "auction_id", F.col("user_id").alias("winner_id"), F.col("bid_amount").alias("final_bid")
    )
    return due_auctions(auctions, results, as_of).join(best, "auction_id", "left").select(
        "auction_id", "winner_id", "final_bid",
        ntz(as_of).alias("closed_at"), F.lit("expired").alias("closed_reason"),
        F.lit(False).alias("is_paid"),
    )


def won_notifications(results: DataFrame, as_of: str) -> DataFrame:
    """A 'won' notification per result with a winner."""
    return results.where(F.col("winner_id").isNotNull()).select(
        F.col("winner_id").alias("user_id"), "auction_id", F.lit("won").alias("type"),
        ntz(as_of).alias("created_at"), F.lit(False).alias("is_read"),
    )


def close_expired(
    auctions: DataFrame,
    bids: DataFrame,
    messages: DataFrame,
    as_of: str,
    results: DataFrame | None = None,
    text: str = WIN_TEXT,
    pin: bool = False,
) -> Closing:
    """Close every active auction whose end has passed.

    `pin` checkpoints the new results, so that a job which writes all outputs ranks the
    bids once.
    """
    new_results = expired_results(auctions, bids, results, as_of)
    closed = due_auctions(auctions, results, as_of)
    if pin:
        new_results = pinned(new_results)
        closed = new_results
    return Closing(
        auctions=deactivate(auctions, closed, as_of),
        results=new_results,
        notifications=won_notifications(new_results, as_of),
        messages=win_messages(new_results, messages, as_of, text),
    )


def buy_now_sales(
    auctions: DataFrame, requests: DataFrame, results: DataFrame | None = None
) -> DataFrame:
    """The bids that buy: per auction the first of (id, auction_id, user_id, created_at) requests.

    Only active auctions count; one without a buy-now price cannot be sold this way (a
    bid needs an amount). The current highest bid does not matter.
    """
    open_now = auctions.where(F.col("is_active") & (F.col("buy_now_price") > 0)).select(
        F.col("id").alias("auction_id"), "buy_now_price"
    )
    if results is not None:
        open_now = open_now.join(results.select("auction_id"), "auction_id", "left_anti")
    first = requests.groupBy("auction_id").agg(
        F.min(F.struct("created_at", "id", "user_id")).alias("_first")
    )
    return open_now.join(first, "auction_id").select(
        "auction_id",
        F.col("_first.user_id").alias("user_id"),
        F.col("buy_now_price").alias("bid_amount"),
        F.col("_first.created_at").alias("created_at"),
    )


def buy_now_results(sold: DataFrame) -> DataFrame:
    return sold.select(
        "auction_id", F.col("user_id").alias("winner_id"), F.col("bid_amount").alias("final_bid"),
        F.col("created_at").alias("closed_at"), F.lit("buy_now").alias("closed_reason"),
        F.lit(False).alias("is_paid"),
    )


def buy_now(
    auctions: DataFrame,
    requests: DataFrame,
    messages: DataFrame,
    as_of: str,
    results: DataFrame | None = None,
    text: str = WIN_TEXT,
    pin: bool = False,
) -> Closing:
    """Sell active auctions at their buy-now price to the first request each.

    Each purchase is also a bid; no 'won' notification is written. The message goes into
    the buyer's highest-numbered conversation (the expiry sweep uses the first one).
    """
    sold = buy_now_sales(auctions, requests, results)
    if pin:
        sold = pinned(sold)
    new_results = buy_now_results(sold)
    last_conversation = messages.groupBy("user_id").agg(
        F.max("conversation_id").alias("conversation_id")
    )
    return Closing(
        auctions=deactivate(auctions, sold, as_of),
        results=new_results,
        notifications=None,
        messages=win_messages(new_results, messages, as_of, text, into=last_conversation),
        bids=sold,
    )
