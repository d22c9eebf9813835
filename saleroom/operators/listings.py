"""Listings: browsing, search, keyed reads, cards, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions import text
from saleroom.functions.ordering import newest


SEARCHED = ("title", "category", "description")


def shown() -> Column:
    # equality, not NOT: a NULL flag hides the listing
    return (F.col("hide") == F.lit(False)) & (F.col("is_deleted") == F.lit(False))


def visible(listings: DataFrame) -> DataFrame:
    """Listings that are neither hidden nor deleted, newest first."""
    return listings.where(shown()).orderBy(newest("created_at"), newest("id"))


def matches(term: str | Column) -> Column:
    pattern = f"%{term}%" if isinstance(term, str) else F.concat(F.lit("%"), term, F.lit("%"))
    hit = F.lit(False)
    for name in SEARCHED:
        column = F.col(name)
        found = column.ilike(pattern) if isinstance(pattern, str) else F.ilike(column, pattern)
        hit = hit | F.coalesce(found, F.lit(False))
    return hit


def search(listings: DataFrame, term: str) -> DataFrame:
    """Visible listings whose title, category or description contains the term.

    Case-insensitive; `%` and `_` in the term act as wildcards.
    """
    return listings.where(shown() & matches(term)).orderBy(newest("created_at"), newest("id"))


def search_terms(listings: DataFrame, terms: list[str]) -> DataFrame:
    """One row per (term, matching visible listing): one scan for all terms, no join."""
    hits = [F.when(matches(term), F.lit(term)) for term in dict.fromkeys(terms)]
    return listings.where(shown()).withColumn("term", F.explode(F.array_compact(F.array(*hits))))


def by_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a table for a set of keys (a one-column DataFrame)."""
    return table.join(keys.toDF(key).distinct(), key, "left_semi")


def missing(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The requested keys the table does not have."""
    return keys.toDF(key).distinct().join(table.select(key), key, "left_anti")


def by_author(listings: DataFrame, author_id: int | None = None) -> DataFrame:
    """Listings of one author, or of every author, newest first."""
    if author_id is not None:
        return listings.where(F.col("author_id") == author_id).orderBy(newest("created_at"), newest("id"))
    return listings.orderBy("author_id", newest("created_at"), newest("id"))


def cards(listings: DataFrame, images: DataFrame) -> DataFrame:
    """Visible listings with their lowest-id extra image as fallback, newest first."""
    first = images.groupBy(F.col("post_id").alias("id")).agg(
        F.min_by("image_url", "id").alias("fallback_image_url")
    )
    return (
        listings.where(shown()).join(first, "id", "left").orderBy(newest("created_at"), newest("id"))
    )


def image_rows(listing_images: DataFrame) -> DataFrame:
    """One row per image of a (post_id, image_urls) list, with its position and public id."""
    return listing_images.select(
        "post_id", F.posexplode("image_urls").alias("position", "image_url")
    ).withColumn("public_id", text.url_tail(F.col("image_url")))


def inventory_totals(listings: DataFrame) -> DataFrame:
    """Listing count and summed numeric price per category."""
    return listings.groupBy("category").agg(
        F.count("*").alias("n_items"),
        F.sum(text.price_number(F.col("price")).cast("decimal(18,2)")).alias("total_value"),
    )


def inventory_export(listings: DataFrame, author_id: int | None = None) -> DataFrame:
    """The inventory sheet: six text columns, hidden and deleted included, newest first."""
    return by_author(listings, author_id).select(
        text.us_date(F.col("created_at")).alias("created_at"),
        "title", "description", "image_url", "category", "price",
    )


def editable(listings: DataFrame, principals: DataFrame, admin_email: str) -> DataFrame:
    """(user_id, post_id) pairs a principal may edit: own listings, everything for the admin.

    The admin is one principal, found by e-mail; the rest is an equi-join on the author.
    """
    own = listings.select(F.col("id").alias("post_id"), F.col("author_id").alias("user_id")).join(
        principals.select(F.col("id").alias("user_id")), "user_id"
    )
    admin_id = principals.where(F.col("email") == admin_email).agg(F.min("id")).scalar()
    everything = listings.select(
        admin_id.alias("user_id"), F.col("id").alias("post_id"), "author_id"
    ).where(F.col("user_id").isNotNull() & ~F.col("author_id").eqNullSafe(F.col("user_id")))
    return own.select("user_id", "post_id").unionByName(everything.select("user_id", "post_id"))


def may_manage(principals: DataFrame, allowed_emails: list[str]) -> DataFrame:
    """Principals with an `is_admin` flag from the allow-list."""
    return principals.withColumn("is_admin", F.col("email").isin(allowed_emails))


def orphaned_images(old: DataFrame, new: DataFrame) -> DataFrame:
    """Images an edit dropped: old (post_id, image_url) rows without a new counterpart.

    Row by row, so duplicates in the old list stay. Adds the storage key.
    """
    return old.join(new.select("post_id", "image_url").distinct(), ["post_id", "image_url"], "left_anti") \
        .withColumn("storage_key", text.url_key(F.col("image_url")))


def dropped_from_lists(old_urls: Column, new_urls: Column) -> Column:
    """The same difference on two array columns; duplicates stay, NULL lists are empty."""
    new_urls = F.coalesce(new_urls, F.array().cast("array<string>"))
    return F.filter(
        F.coalesce(old_urls, F.array().cast("array<string>")),
        lambda url: ~F.array_contains(new_urls, url),
    )
