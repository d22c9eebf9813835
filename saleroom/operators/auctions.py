"""Auctions and bids: rankings, the bid ledger, extensions, wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleroom.functions.ordering import newest
from saleroom.functions.skew import PART, in_parts
from saleroom.functions.time import micros_between, ntz

# A bid in the last minute moves the end by five minutes.
EXTENSION_WINDOW_SECONDS = 60
EXTENSION_SECONDS = 300


def by_end_time(auctions: DataFrame) -> DataFrame:
    """All auctions, closed ones too, latest end first."""
    return auctions.orderBy(newest("end_time"), "id")


def expired(auctions: DataFrame, as_of: str) -> DataFrame:
    """Active auctions whose end has passed."""
    return auctions.where(F.col("is_active") & (F.col("end_time") <= ntz(as_of)))


def schedule(auctions: DataFrame, as_of: str) -> DataFrame:
    """Active auctions with the whole seconds left; overdue ones count as 0."""
    left = micros_between(ntz(as_of), F.col("end_time"))
    return auctions.where("is_active").select(
        "id", "end_time",
        F.greatest(F.expr("0L"), F.floor(left / 1_000_000)).cast("bigint").alias("seconds_left"),
        (left <= 0).alias("overdue"),
    )


def bid_history(bids: DataFrame) -> DataFrame:
    """Bids by auction in rank order. The range sort also splits a hot auction."""
    return bids.orderBy("auction_id", newest("bid_amount"), "created_at", "id")


def user_bids(bids: DataFrame, user_id: int | None = None) -> DataFrame:
    """Bids of one user, or by user, newest first."""
    if user_id is not None:
        return bids.where(F.col("user_id") == user_id).orderBy(newest("created_at"), "id")
    return bids.orderBy("user_id", newest("created_at"), "id")


def _rank() -> Column:
    """Higher amount first, then the earlier bid, then the lower id: smallest is best."""
    return F.struct(
        (-F.col("bid_amount")).alias("neg_amount"), F.col("created_at"), F.col("id"), F.col("user_id")
    )


def top_bid(bids: DataFrame) -> DataFrame:
    """The highest bid per auction. Combined map-side: one row per auction is shuffled."""
    return bids.groupBy("auction_id").agg(F.min(_rank()).alias("best")).select(
        "auction_id",
        F.col("best.id").alias("bid_id"),
        F.col("best.user_id").alias("user_id"),
        (-F.col("best.neg_amount")).alias("bid_amount"),
        F.col("best.created_at").alias("created_at"),
    )


def current_bid(bids: DataFrame) -> DataFrame:
    """The current bid per auction: the highest amount ever offered."""
    return bids.groupBy("auction_id").agg(F.max("bid_amount").alias("current_bid"))


def bid_ledger(bids: DataFrame) -> DataFrame:
    """Every bid with the bid it had to beat, and whether it was accepted.

    A bid is accepted when it is strictly higher than all earlier bids of its
    auction (ties in time are ordered by id); rows flagged `is_buy_now`, where that
    column exists, are always accepted and raise the mark as well. Adds
    `prior_amount`, `prior_user_id`, `accepted` and `reason`.

    Running maximum per auction and part of the ordered bids; each part starts from the
    best bid of the auction's parts before it.
    """
    parted = in_parts(bids, ["auction_id", "created_at", "id"]).withColumn("_rank", _rank())
    earlier = (
        Window.partitionBy("auction_id", PART)
        .orderBy("created_at", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # a row per auction and part; an auction has at most as many as there are parts
    per_part = parted.groupBy("auction_id", PART).agg(F.min("_rank").alias("_best"))
    parts_before = (
        Window.partitionBy("auction_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_part.select(
        F.col("auction_id").alias("_auction"), F.col(PART).alias("_at"), F.min("_best").over(parts_before).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    here = F.col("auction_id").eqNullSafe(F.col("_auction")) & (F.col(PART) == F.col("_at"))
    ledger = (
        parted.withColumn("_local", F.min("_rank").over(earlier))
        .join(carried, here, "left")
        .withColumn("_prior", F.least("_local", "_carried"))
        .withColumn("prior_amount", -F.col("_prior.neg_amount"))
        .withColumn("prior_user_id", F.col("_prior.user_id"))
    )
    accepted = F.col("prior_amount").isNull() | (F.col("bid_amount") > F.col("prior_amount"))
    if "is_buy_now" in bids.columns:
        accepted = F.coalesce(F.col("is_buy_now"), F.lit(False)) | accepted
    return (
        ledger.withColumn("accepted", accepted)
        .withColumn("reason", F.when(~F.col("accepted"), F.lit("not higher than the current bid")))
        .drop(PART, "_rank", "_local", "_auction", "_at", "_carried", "_prior")
    )


def accepted_bids(bids: DataFrame) -> DataFrame:
    return bid_ledger(bids).where("accepted").select(*bids.columns)


def outbid_notices(bids: DataFrame) -> DataFrame:
    """One notice per accepted bid to the holder it displaced, unless that is the bidder."""
    return (
        bid_ledger(bids)
        .where(F.col("accepted") & (F.col("prior_user_id") != F.col("user_id")))
        .select(
            F.col("id").alias("bid_id"),
            "auction_id",
            F.col("prior_user_id").alias("user_id"),
            F.col("bid_amount").alias("new_bid_amount"),
            F.lit("outbid").alias("type"),
            "created_at",
        )
    )


def extension_hits(
    auctions: DataFrame,
    bids: DataFrame,
    window_seconds: int = EXTENSION_WINDOW_SECONDS,
    step_seconds: int = EXTENSION_SECONDS,
) -> DataFrame:
    """Distinct (auction_id, k): some bid falls into the last minute before the k-th end.

    The k-th end is `end_time + k * step`, so its last minute is a fixed interval and
    a bid belongs to at most one of them (the window is not longer than the step).
    """
    if window_seconds > step_seconds:
        raise ValueError("the extension window must not be longer than the extension")
    step = step_seconds * 1_000_000
    ends = auctions.where("is_active").select(F.col("id").alias("auction_id"), "end_time")
    late = (
        bids.select("auction_id", "created_at")
        .join(ends, "auction_id")
        .withColumn("_d", micros_between(F.col("end_time"), F.col("created_at")))
        .where(F.col("_d") >= -window_seconds * 1_000_000)
        # smallest k whose end lies strictly after the bid
        .withColumn("k", F.expr(f"(_d - pmod(_d, {step}L)) div {step}L + 1"))
        .where(f"k >= 0 AND k * {step}L - _d <= {window_seconds * 1_000_000}L")
    )
    return late.select("auction_id", "k").distinct()


def extended_end_times(
    auctions: DataFrame,
    bids: DataFrame,
    window_seconds: int = EXTENSION_WINDOW_SECONDS,
    step_seconds: int = EXTENSION_SECONDS,
) -> DataFrame:
    """Final end of each active auction after all last-minute extensions.

    The end moves from k to k+1 exactly when the k-th last minute saw a bid, so the
    number of extensions is the length of the unbroken run k = 0, 1, 2, … No bid
    list is ever collected: only distinct (auction, k) pairs reach the window.
    """
    hits = extension_hits(auctions, bids, window_seconds, step_seconds)
    in_order = Window.partitionBy("auction_id").orderBy("k")
    runs = (
        hits.withColumn("_rn", F.row_number().over(in_order))
        .where("k = _rn - 1")
        .groupBy("auction_id")
        .agg(F.count("*").alias("extensions"))
    )
    moved = F.make_dt_interval(secs=(F.col("extensions") * step_seconds).cast("decimal(18,6)"))
    return (
        auctions.where("is_active")
        .select(F.col("id").alias("auction_id"), "end_time")
        .join(runs, "auction_id", "left")
        .withColumn("extensions", F.coalesce("extensions", F.expr("0L")))
        .select("auction_id", "extensions", (F.col("end_time") + moved).alias("end_time"))
    )


def _wins(results: DataFrame, auctions: DataFrame) -> DataFrame:
    facts = auctions.select(
        F.col("id").alias("auction_id"), "title", "image_urls", "buy_now_price"
    )
    return (
        results.where(F.col("winner_id").isNotNull())
        .join(facts, "auction_id")
        .withColumn("is_paid", F.coalesce("is_paid", F.lit(False)))
    )


def user_wins(results: DataFrame, auctions: DataFrame) -> DataFrame:
    """Results with a winner and their auction, newest first; a NULL paid flag is unpaid."""
    return _wins(results, auctions).orderBy(newest("closed_at"), "id")


def for_admin(auctions: DataFrame, results: DataFrame) -> DataFrame:
    """All auctions with payment and tracking where a result exists, latest end first."""
    extra = [c for c in ("is_paid", "tracking_number") if c in results.columns]
    paid = results.select(F.col("auction_id").alias("id"), *extra)
    return auctions.join(paid, "id", "left").orderBy(newest("end_time"), "id")


def bids_with_profile(bids: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bids with the bidder's profile nested as `user`; NULL when there is none."""
    others = [c for c in profiles.columns if c != "user_id"]
    nested = profiles.select("user_id", F.struct("user_id", *others).alias("user"))
    return bids.join(nested, "user_id", "left").orderBy(
        "auction_id", newest("bid_amount"), "created_at", "id"
    )


def outcomes(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Why each auction closed, with the winner's first name (and image) or NULL."""
    extra = [c for c in ("first_name", "image_url") if c in profiles.columns]
    winners = profiles.select(F.col("user_id").alias("winner_id"), *extra)
    return results.select("auction_id", "closed_reason", "winner_id").join(winners, "winner_id", "left")


def user_dashboard(bids: DataFrame, results: DataFrame, auctions: DataFrame) -> DataFrame:
    """Bids and wins of every user in one feed, one row per item, newest first per user.

    Rows rather than one list per user: a user with very many bids stays spread out.
    """
    placed = bids.select(
        "user_id", F.lit("bid").alias("section"), F.col("id").alias("item_id"), "auction_id",
        F.col("bid_amount").alias("amount"), F.col("created_at").alias("at"),
        F.lit(None).cast("string").alias("title"),
    )
    won = _wins(results, auctions).select(
        F.col("winner_id").alias("user_id"), F.lit("win").alias("section"),
        F.col("id").alias("item_id"), "auction_id", F.col("final_bid").alias("amount"),
        F.col("closed_at").alias("at"), "title",
    )
    return placed.unionByName(won).orderBy("user_id", "section", newest("at"), "item_id")


def as_json(auctions: DataFrame) -> DataFrame:
    """Auction rows as JSON text with camel-case names."""
    names = {
        "id": "id", "title": "title", "description": "description", "image_urls": "imageUrls",
        "start_price": "startPrice", "buy_now_price": "buyNowPrice", "current_bid": "currentBid",
        "start_time": "startTime", "end_time": "endTime", "is_active": "isActive",
        "creator_id": "creatorId", "created_at": "createdAt", "updated_at": "updatedAt",
        "is_paid": "isPaid", "tracking_number": "trackingNumber",
    }
    fields = [F.col(c).alias(names[c]) for c in auctions.columns if c in names]
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ignoreNullFields": "false"}
    return auctions.select("id", F.to_json(F.struct(*fields), options).alias("json"))
