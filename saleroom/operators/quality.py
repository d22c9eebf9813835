"""Input checks with reasons, the error log, job counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ordering import newest
from saleroom.functions.text import is_blank, is_digits, truthy


def check(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `failed`: the names of the rules a row breaks. A rule is TRUE when the row is fine."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return rows.withColumn("failed", F.array_compact(F.array(*broken)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined rows with their `failed` rules."""
    good = checked.where(F.size("failed") == 0).drop("failed")
    return good, checked.where(F.size("failed") > 0)


def bid_rules() -> dict[str, Column]:
    """All three fields present; zero counts as missing."""
    return {
        "auction_id is required": truthy(F.col("auction_id")),
        "user_id is required": truthy(F.col("user_id")),
        "bid_amount is required": truthy(F.col("bid_amount")),
    }


def sale_rules() -> dict[str, Column]:
    return {
        "buyer_email is required": F.coalesce("buyer_email", F.lit("")) != "",
        "post_id is required": truthy(F.col("post_id")),
        "price is required": truthy(F.col("price")),
        "price is too large": F.col("price").isNull()
        | F.col("price").try_cast("decimal(10,2)").isNotNull()
        | ~truthy(F.col("price")),
    }


def message_rules() -> dict[str, Column]:
    return {"message_content is required": F.coalesce("message_content", F.lit("")) != ""}


def tracking_rules() -> dict[str, Column]:
    return {"tracking_number must be text": F.coalesce("tracking_number", F.lit("")) != ""}


def paid_rules() -> dict[str, Column]:
    """`is_paid` must be a boolean; given as text, 'true' or 'false'."""
    return {"is_paid must be boolean": F.col("is_paid").cast("string").isin("true", "false")}


def id_rules(name: str = "id") -> dict[str, Column]:
    return {f"{name} must be digits": is_digits(F.col(name).cast("string"))}


def broadcast_rules() -> dict[str, Column]:
    return {
        "subject is required": ~is_blank(F.col("subject")),
        "message is required": ~is_blank(F.col("message")),
    }


def recent_errors(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest errors; a top-k, never a full sort."""
    return log.orderBy(newest("created_at"), newest("id")).limit(limit)


def job_counts(steps: dict[str, DataFrame]) -> DataFrame:
    """Row count per named step output, as one small table."""
    counts = [
        rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("step"), "n_rows")
        for name, rows in steps.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result
