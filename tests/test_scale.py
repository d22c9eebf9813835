"""Plans: what is read, what is joined how, what happens to a hot key."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from saleroom import queries as catalogue
from saleroom.functions.skew import in_parts
from saleroom.operators import auctions, listings, messaging
from saleroom.plans import changes
from tests.conftest import SMALL

# These run jobs while they are built (numbering, streams), so they are left out here.
EAGER = {
    "accepted_bids", "bid_ledger", "outbid_notices", "notification_feed",
    "append_with_defaults", "upsert_addresses", "close_expired_messages", "buy_now_messages", "swap_to_listing",
    "swap_images", "assign_conversations", "mail_after_cooldown", "stream_bids", "stream_auction_close",
    "stream_mail_throttle", "stream_inbox", "rate_limit_audit", "typing_sessions", "latest_status", "message_routing",
    "rate_limit_requests", "rate_limit_test_requests", "rate_limit_mail_actions", "stream_bids_and_purchases", "stream_inbox_reads",
}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", [n for n in catalogue.CATALOGUE if n not in EAGER])
def test_no_cross_join_and_no_python_rows(market, name):
    text = plan(catalogue.CATALOGUE[name][0](market))
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    assert "EvalPython" not in text


def test_scans_read_only_what_is_needed(market):
    text = plan(auctions.current_bid(market["v_bids"]))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text
    text = plan(catalogue.CATALOGUE["unread_notifications"][0](market))
    assert "In(event_type, [click,purchase])" in text


def test_rank_is_combined_before_the_shuffle(market):
    text = plan(auctions.top_bid(market["v_bids"]))
    assert text.count("Exchange hashpartitioning") <= 1 and "partial_min" in text


def test_a_burst_on_one_auction_spreads_over_the_parts(spark):
    """Most bids on one auction, all within two minutes and half of them at one instant."""
    bids = spark.range(0, 40_000, 1, 8).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 97).cast("bigint").alias("auction_id"),
        (F.col("id") % 501).alias("user_id"), (F.col("id") * 7919 % 30_011).cast("int").alias("bid_amount"),
        F.timestamp_add("MILLISECOND", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 3), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
    )
    with settings(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}):
        sizes = [r["count"] for r in in_parts(bids, ["auction_id", "created_at", "id"]).groupBy("_part").count().collect()]
        got = {(r.id, r.accepted) for r in auctions.bid_ledger(bids).select("id", "accepted").collect()}
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    best, wanted = {}, set()
    for r in sorted(bids.collect(), key=lambda r: (r.auction_id, r.created_at, r.id)):
        wanted.add((r.id, r.auction_id not in best or r.bid_amount > best[r.auction_id]))
        best[r.auction_id] = max(r.bid_amount, best.get(r.auction_id, r.bid_amount))
    assert got == wanted


@pytest.fixture
def hot_thread(spark):
    """200,000 messages, every second one by user 1."""
    return spark.range(0, 200_000, 1, 8).select(
        F.col("id"), (F.col("id") % 977).alias("conversation_id"),
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 5003).cast("bigint").alias("user_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("message_content"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("sent_at"),
        F.lit(False).alias("is_read"), (F.col("id") % 2 == 0).alias("is_from_admin"),
    )


def test_a_hot_sender_is_split_at_run_time(spark, hot_thread):
    people = spark.range(0, 6000).select("id", F.concat(F.lit("u"), F.col("id")).alias("email"))
    with settings(spark, **{
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500KB",
        "spark.sql.shuffle.partitions": "16",
    }):
        joined = messaging.with_email(hot_thread, people)
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.collect()
        assert len(rows) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_a_long_thread_is_one_row_before_its_join(hot_thread, spark):
    people = spark.range(0, 6000).select("id", F.concat(F.lit("u"), F.col("id")).alias("email"))
    faces = people.select(F.col("id").alias("user_id"), F.lit("x").alias("first_name"))
    text = plan(messaging.inbox_summary(hot_thread, people, faces))
    assert text.count("partial_count") >= 1 and "message_content" not in text.split("(1)")[-1].split("Project")[-1]


def test_equal_timestamps_do_not_fill_one_range(spark, hot_thread):
    """All rows share one time: the id in the sort key still spreads them."""
    rows = hot_thread.select("id", F.col("sent_at").alias("created_at"), F.lit(False).alias("hide"), F.lit(False).alias("is_deleted"))
    with settings(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}):
        sizes = listings.visible(rows).groupBy(F.spark_partition_id()).count().collect()
        spread = listings.visible(rows).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) < 60_000, sizes


def test_retention_skips_expired_days(spark, market, tmp_path):
    path = str(tmp_path / "notifications")
    market["v_notifications"].withColumn("created_date", F.col("created_at").cast("date")).write.partitionBy(
        "created_date"
    ).parquet(path)
    stored = spark.read.parquet(path)
    kept = changes.purge_notifications(stored, "2024-02-10 06:00:00")
    line = next(x for x in plan(kept).splitlines() if x.startswith("PartitionFilters"))
    assert "created_date" in line and ">= 2024-01-11" in line
    plain = changes.purge_notifications(market["v_notifications"], "2024-02-10 06:00:00")
    assert kept.count() == plain.count() > 0
