"""Users, profiles and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ordering import newest
from saleroom.functions.text import is_blank, url_key
from saleroom.functions.time import ntz


def by_profile_date(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """All users with their profile's date; those without a profile come first."""
    dates = profiles.select(
        F.col("user_id").alias("id"), F.col("created_at").alias("profile_created_at")
    )
    return users.join(dates, "id", "left").orderBy(newest("profile_created_at"), "id")


def addresses_by_user(addresses: DataFrame, user_id: int | None = None) -> DataFrame:
    """Addresses of one user, or by user, newest first."""
    if user_id is not None:
        return addresses.where(F.col("user_id") == user_id).orderBy(newest("created_at"), newest("id"))
    return addresses.orderBy("user_id", newest("created_at"), newest("id"))


def latest_address(addresses: DataFrame) -> DataFrame:
    """The newest address per user; the higher id wins a tie, an undated one loses."""
    rest = [c for c in addresses.columns if c not in ("user_id", "id")]
    newest_row = F.struct(
        F.coalesce("created_at", ntz("1970-01-01 00:00:00")).alias("_at"), F.col("id"),
        *[F.col(c).alias(f"_{c}") for c in rest],
    )
    best = addresses.groupBy("user_id").agg(F.max(newest_row).alias("_best"))
    return best.select(
        "user_id", F.col("_best.id").alias("id"), *[F.col(f"_best._{c}").alias(c) for c in rest]
    )


def directory(users: DataFrame, profiles: DataFrame, addresses: DataFrame) -> DataFrame:
    """Users with nested `profile` and latest `address`, NULL where absent."""
    home = latest_address(addresses)
    nested_profile = profiles.select(
        F.col("user_id").alias("id"), F.struct(*profiles.columns).alias("profile")
    )
    nested_address = home.select(
        F.col("user_id").alias("id"), F.struct(*addresses.columns).alias("address")
    )
    return users.join(nested_profile, "id", "left").join(nested_address, "id", "left")


def replaced_images(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Storage keys of profile images that a (user_id, image_url) change replaces."""
    new = changes.select("user_id", F.col("image_url").alias("_new"))
    old = profiles.select("user_id", "image_url").where(F.coalesce("image_url", F.lit("")) != "")
    return (
        old.join(new, "user_id")
        .where(~F.col("image_url").eqNullSafe(F.col("_new")))
        .select("user_id", "image_url", url_key(F.col("image_url")).alias("storage_key"))
    )


def address_class() -> Column:
    """'none', 'partial' or 'complete', from street, city, state and postal code."""
    filled = [~is_blank(F.col(c)) for c in ("address_line1", "city", "state", "postal_code")]
    every, some = filled[0], filled[0]
    for flag in filled[1:]:
        every, some = every & flag, some | flag
    return F.when(every, "complete").when(some, "partial").otherwise("none")


def address_quality(addresses: DataFrame) -> DataFrame:
    return addresses.withColumn("quality", address_class())
