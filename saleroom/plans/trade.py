"""Listing trade jobs: recording sales, discounts, turning auctions into listings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions import text
from saleroom.functions.ids import with_new_ids
from saleroom.functions.time import ntz
from saleroom.operators.quality import check, sale_rules, split
from saleroom.operators.sales import resolve_buyers
from saleroom.plans.changes import overwrite, set_where


def record_sales(
    requests: DataFrame, users: DataFrame, listings: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn sale requests into sale rows and mark their listings sold.

    Returns (new sales, next listings, rejected requests with `reason`). Requests with
    a missing field or an unknown buyer e-mail are rejected.
    """
    good, incomplete = split(check(requests, sale_rules()))
    matched, unknown = resolve_buyers(good, users)
    tracking = F.col("tracking") if "tracking" in requests.columns else F.lit(None).cast("string")
    sales = matched.select(
        F.col("id").alias("request_id"), "post_id", "buyer_id",
        F.col("price").cast("decimal(10,2)").alias("price"),
        F.nullif(tracking, F.lit("")).alias("tracking_number"),
        F.lit(False).alias("is_paid"), ntz(as_of).alias("created_at"),
    )
    sold = set_where(listings, sales.select("post_id"), {"sold": F.lit(True)})
    rejected = incomplete.select("id", F.array_join("failed", "; ").alias("reason")).unionByName(
        unknown.select("id", F.lit("buyer not found").alias("reason"))
    )
    return sales, sold, rejected


def apply_discount(listings: DataFrame, author_id: int, percentage: int | str) -> DataFrame:
    """Next version of the listings after a percentage discount on one author's items.

    `original_price` is always set to the current price text, also when an earlier
    discount had stored another one; `discounted_price` is a decimal (NULL when the
    price does not start with a number) and is formatted only where it is written out.
    """
    factor = (Decimal(100) - Decimal(str(percentage))) / Decimal(100)
    mine = F.col("author_id") == author_id
    cut = (text.price_number(F.col("price")) * F.lit(factor).cast("decimal(7,4)")).cast("decimal(18,4)")
    return _priced(listings).withColumns({
        "discounted_price": F.when(mine, cut).otherwise(F.col("discounted_price")),
        "original_price": F.when(mine, F.col("price")).otherwise(F.col("original_price")),
    })


def undo_discount(listings: DataFrame, author_id: int) -> DataFrame:
    """Next version of the listings after undoing discounts: both price columns become NULL."""
    mine = F.coalesce(F.col("author_id") == author_id, F.lit(False))
    return _priced(listings).withColumns({
        "discounted_price": F.when(~mine, F.col("discounted_price")),
        "original_price": F.when(~mine, F.col("original_price")),
    })


def _priced(listings: DataFrame) -> DataFrame:
    if "original_price" not in listings.columns:
        listings = listings.withColumn("original_price", F.lit(None).cast("string"))
    if "discounted_price" not in listings.columns:
        listings = listings.withColumn("discounted_price", F.lit(None).cast("decimal(18,4)"))
    else:
        listings = listings.withColumn(
            "discounted_price", F.col("discounted_price").try_cast("decimal(18,4)")
        )
    return listings


def price_text(price: Column) -> Column:
    """A decimal price as text without trailing zeros: 90, 76.585."""
    return F.regexp_replace(price.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")


def edit_listings(listings: DataFrame, edits: DataFrame) -> DataFrame:
    """Full overwrite of edited listings; the original price follows the new price."""
    return overwrite(listings, edits.withColumn("original_price", F.col("price")))


def swap_to_listings(auctions: DataFrame, listings: DataFrame, as_of: str) -> DataFrame:
    """New listing rows for auctions that move to the gallery, numbered in auction order.

    Price: the buy-now price unless it is NULL or 0, else the start price. The caller
    deletes the auctions and their results with `changes.delete`.
    """
    cover = F.get(F.col("image_urls"), F.lit(0))
    rows = auctions.select(
        F.col("id").alias("auction_id"), "title", "description",
        cover.alias("image_url"),
        F.lit(None).cast("string").alias("category"),
        F.coalesce(F.nullif(F.col("buy_now_price"), F.lit(0)), F.col("start_price"))
        .cast("string").alias("price"),
        F.col("creator_id").alias("author_id"),
        text.url_tail(cover).alias("public_id"),
        F.size(F.coalesce("image_urls", F.array().cast("array<string>"))).cast("bigint").alias("num_imgs"),
        F.lit(False).alias("sold"), F.lit(False).alias("hide"), F.lit(False).alias("is_deleted"),
        ntz(as_of).alias("created_at"),
    )
    return with_new_ids(rows, listings, ["auction_id"])


def swap_images(auctions: DataFrame, new_listings: DataFrame) -> DataFrame:
    """Image rows of swapped auctions: all image URLs, in order, with their public ids."""
    ids = new_listings.select("auction_id", F.col("id").alias("post_id"))
    exploded = auctions.select(
        F.col("id").alias("auction_id"), F.posexplode("image_urls").alias("position", "image_url")
    )
    return exploded.join(ids, "auction_id").select(
        "post_id", "position", "image_url", text.url_tail(F.col("image_url")).alias("public_id")
    )
