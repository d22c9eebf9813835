"""End-to-end jobs: read the current tables, apply a change, publish it as one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from saleroom.functions.ids import with_new_ids
from saleroom.functions.time import ntz
from saleroom.operators.auctions import outbid_notices
from saleroom.plans import changes, closing, trade
from saleroom.plans.conversations import assign
from saleroom.sources.snapshots import Snapshot, SnapshotStore, empty_table


def new_rows(now: Snapshot, name: str, rows: DataFrame, order: list[str], as_of: str) -> DataFrame:
    """Rows with the next ids, the defaults and exactly the columns of the table."""
    current = now.read(name)
    filled = changes.with_defaults(with_new_ids(rows, current, order), name, as_of)
    shape = empty_table(now.store.spark, name)
    return shape.unionByName(
        filled.select(*[c for c in filled.columns if c in shape.columns]), allowMissingColumns=True
    ).select(*shape.columns)


def close_expired(store: SnapshotStore, as_of: str, text: str = closing.WIN_TEXT) -> int:
    """Close due auctions: auctions replaced; results, notifications and messages added."""
    now = store.snapshot()
    done = closing.close_expired(
        now.read("auctions"), now.read("bids"), now.read("messages"), as_of,
        now.read("auction_results"), text, pin=True,
    )
    return _publish_closing(now, done, as_of)


def buy_now(store: SnapshotStore, requests: DataFrame, as_of: str, text: str = closing.WIN_TEXT) -> int:
    """Sell auctions at their buy-now price: auctions replaced; bids, results and messages added."""
    now = store.snapshot()
    done = closing.buy_now(
        now.read("auctions"), requests, now.read("messages"), as_of,
        now.read("auction_results"), text, pin=True,
    )
    return _publish_closing(now, done, as_of)


def _publish_closing(now: Snapshot, done: closing.Closing, as_of: str) -> int:
    added = {
        "auction_results": new_rows(now, "auction_results", done.results, ["auction_id"], as_of),
        "messages": new_rows(now, "messages", done.messages, ["auction_id"], as_of),
    }
    if done.notifications is not None:
        added["notifications"] = new_rows(
            now, "notifications", done.notifications, ["auction_id"], as_of
        )
    if done.bids is not None:
        added["bids"] = new_rows(now, "bids", done.bids, ["auction_id"], as_of)
    return now.store.commit({"auctions": done.auctions}, added, base=now.version)


def record_outbids(store: SnapshotStore, as_of: str) -> int:
    """Store the outbid notices of all bids (for a table that has none yet)."""
    now = store.snapshot()
    notices = outbid_notices(now.read("bids"))
    return store.commit(
        append={"notifications": new_rows(now, "notifications", notices, ["bid_id"], as_of)}, base=now.version
    )


def post_messages(store: SnapshotStore, new: DataFrame, as_of: str) -> int:
    """Add a batch of (id, user_id, message_content, …) messages, each in its conversation.

    `id` orders the batch; the stored rows get ids of their own. A `sent_at` or
    `conversation_id` in the batch is respected.
    """
    now = store.snapshot()
    if "sent_at" not in new.columns:
        new = new.withColumn("sent_at", ntz(as_of))
    placed = assign(new, now.read("messages")).withColumnRenamed("id", "_request")
    return store.commit(
        append={"messages": new_rows(now, "messages", placed, ["sent_at", "_request"], as_of)}, base=now.version
    )


def record_sales(store: SnapshotStore, requests: DataFrame, as_of: str) -> tuple[int, DataFrame]:
    """Add the sales of valid requests and mark their listings; also returns the rejects."""
    now = store.snapshot()
    sales, listings, rejected = trade.record_sales(
        requests, now.read("users"), now.read("listings"), as_of
    )
    version = store.commit(
        {"listings": listings}, {"sales": new_rows(now, "sales", sales, ["request_id"], as_of)}, base=now.version
    )
    return version, rejected


def swap_to_listings(store: SnapshotStore, auction_ids: DataFrame, as_of: str) -> int:
    """Turn auctions into listings with images; the auctions and what hangs on them go."""
    now = store.snapshot()
    tables = {n: now.read(n) for n in ("auctions", "bids", "notifications", "auction_results")}
    picked = tables["auctions"].join(auction_ids.toDF("id").distinct(), "id", "left_semi")
    listed = trade.swap_to_listings(picked, now.read("listings"), as_of)
    images = trade.swap_images(picked, listed)
    kept = changes.delete(tables, "auctions", auction_ids, also={"auction_results": "auction_id"})
    shape = empty_table(now.store.spark, "listings")
    rows = shape.unionByName(listed.drop("auction_id"), allowMissingColumns=True)
    return store.commit(
        kept,
        {"listings": rows, "listing_images": new_rows(now, "listing_images", images, ["post_id", "position"], as_of)},
        base=now.version,
    )
