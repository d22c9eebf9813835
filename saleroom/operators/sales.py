"""Direct sales: report, buyer lists, outstanding amounts, buyer resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ordering import newest


def report(
    sales: DataFrame, listings: DataFrame, users: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Sales with listing and buyer, newest first.

    Inner joins: a buyer without a profile does not appear. The full name is NULL
    when either part is.
    """
    items = listings.select(
        F.col("id").alias("post_id"), F.col("title").alias("post_title"), "image_url"
    )
    buyers = users.select(F.col("id").alias("buyer_id"), F.col("email").alias("buyer_email"))
    names = profiles.select(
        F.col("user_id").alias("buyer_id"),
        F.col("first_name").alias("buyer_first_name"),
        F.col("last_name").alias("buyer_last_name"),
        F.concat("first_name", F.lit(" "), "last_name").alias("buyer_name"),
    )
    return (
        sales.join(items, "post_id")
        .join(buyers, "buyer_id")
        .join(names, "buyer_id")
        .orderBy(newest("created_at"), "id")
    )


def buyer_sales(sales: DataFrame, listings: DataFrame, buyer_id: int | None = None) -> DataFrame:
    """Sales with listing details, of one buyer or by buyer, newest first."""
    items = listings.select(
        F.col("id").alias("post_id"),
        F.col("title").alias("post_title"),
        F.col("image_url").alias("post_image_url"),
        F.col("price").alias("post_price"),
    )
    if buyer_id is not None:
        sales = sales.where(F.col("buyer_id") == buyer_id)
        return sales.join(items, "post_id").orderBy(newest("created_at"), "id")
    return sales.join(items, "post_id").orderBy("buyer_id", newest("created_at"), "id")


def outstanding_by_buyer(sales: DataFrame) -> DataFrame:
    """Number and sum of unpaid sales per buyer."""
    return (
        sales.where(F.col("is_paid") == F.lit(False))
        .groupBy("buyer_id")
        .agg(F.count("*").alias("n_unpaid"), F.sum("price").alias("outstanding"))
    )


def resolve_buyers(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the buyer's id, and those whose e-mail nobody has."""
    known = users.select(F.col("email").alias("buyer_email"), F.col("id").alias("buyer_id"))
    matched = requests.join(known, "buyer_email")
    rejected = requests.join(known, "buyer_email", "left_anti")
    return matched, rejected
