"""Jobs over stored tables: each publishes one commit, and repeating them is harmless."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleroom.plans import jobs
from saleroom.sources.snapshots import Conflict, SnapshotStore, empty_table
from tests.conftest import tuples

NOW = "2024-01-10 12:00:00"


@pytest.fixture
def store(spark, frame, tmp_path):
    lots = frame(
        "id BIGINT, title STRING, image_urls ARRAY<STRING>, start_price INT, buy_now_price INT, end_time TIMESTAMP_NTZ, is_active BOOLEAN, creator_id BIGINT",
        (1, "a", ["http://h/x.jpg", "http://h/y.jpg"], 5, 100, "2024-01-10 11:00:00", True, 1),
        (2, "b", [], 5, 200, "2024-01-11", True, 1), (3, "c", [], 5, None, "2024-01-01", True, 1),
    )
    bids = frame("id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ",
                 (1, 1, 7, 10, "2024-01-02"), (2, 1, 8, 20, "2024-01-03"))

    def shaped(name, rows):
        return empty_table(spark, name).unionByName(rows, allowMissingColumns=True)

    store = SnapshotStore(spark, str(tmp_path / "db"))
    store.commit({"auctions": shaped("auctions", lots), "bids": shaped("bids", bids)})
    return store


def test_closing_is_one_commit_and_idempotent(store):
    jobs.close_expired(store, NOW)
    assert tuples(store.read("auction_results"), "id", "auction_id", "winner_id", "final_bid", "closed_reason") == [
        (1, 1, 8, 20, "expired"), (2, 3, None, None, "expired")
    ]
    assert tuples(store.read("notifications"), "id", "user_id", "type", "is_read") == [(1, 8, "won", False)]
    assert tuples(store.read("messages"), "id", "conversation_id", "user_id", "is_from_admin") == [(1, 1, 8, True)]
    assert tuples(store.read("auctions"), "id", "is_active") == [(1, False), (2, True), (3, False)]
    assert store.versions() == [1, 2]
    jobs.close_expired(store, NOW)
    assert store.read("auction_results").count() == 2 and store.read("messages").count() == 1
    # the state before the job can still be read
    assert tuples(store.read("auctions", 1), "is_active") == [(True,)] * 3


def test_buy_now_records_a_bid(store, frame):
    requests = frame("id BIGINT, auction_id BIGINT, user_id BIGINT, created_at TIMESTAMP_NTZ", (1, 2, 9, "2024-01-05"), (2, 3, 9, "2024-01-05"))
    jobs.buy_now(store, requests, NOW)
    assert tuples(store.read("bids").where("auction_id = 2"), "id", "user_id", "bid_amount") == [(3, 9, 200)]
    assert tuples(store.read("auction_results"), "auction_id", "closed_reason") == [(2, "buy_now")]
    assert "notifications" not in store.tables()


def test_outbids_are_stored(store):
    jobs.record_outbids(store, NOW)
    assert tuples(store.read("notifications"), "user_id", "type") == [(7, "outbid")]


def test_swap_moves_an_auction(store, frame):
    jobs.close_expired(store, NOW)
    jobs.swap_to_listings(store, frame("id BIGINT", (1,)), NOW)
    assert tuples(store.read("listings"), "id", "title", "price", "num_imgs", "hide") == [(1, "a", "100", 2, False)]
    assert tuples(store.read("listing_images"), "id", "post_id", "public_id") == [(1, 1, "x.jpg"), (2, 1, "y.jpg")]
    assert tuples(store.read("auctions"), "id") == [(2,), (3,)]
    assert store.read("bids").count() == 0 and store.read("notifications").count() == 0
    assert tuples(store.read("auction_results"), "auction_id") == [(3,)]


def test_messages_are_posted_into_their_conversations(store, frame):
    jobs.close_expired(store, NOW)  # user 8 now has conversation 1
    batch = frame("id BIGINT, user_id BIGINT, message_content STRING, is_from_admin BOOLEAN", (5, 8, "thanks", None), (6, 9, "hello", None))
    jobs.post_messages(store, batch, NOW)
    assert tuples(store.read("messages"), "id", "conversation_id", "user_id", "is_read") == [
        (1, 1, 8, False), (2, 1, 8, False), (3, 2, 9, False)
    ]


def test_sales_are_stored(spark, store, frame):
    people = empty_table(spark, "users").unionByName(frame("id BIGINT, email STRING", (5, "five@x")), allowMissingColumns=True)
    posts = empty_table(spark, "listings").unionByName(frame("id BIGINT, title STRING, sold BOOLEAN", (1, "x", False), (2, "y", False)), allowMissingColumns=True)
    store.commit({"users": people, "listings": posts})
    requests = frame("id BIGINT, post_id BIGINT, buyer_email STRING, price STRING", (1, 2, "five@x", "9.50"), (2, 1, "who@x", "1"))
    _, rejected = jobs.record_sales(store, requests, NOW)
    assert [(i, p, str(v), paid) for i, p, v, paid in tuples(store.read("sales"), "id", "post_id", "price", "is_paid")] == [(1, 2, "9.50", False)]
    assert tuples(store.read("listings"), "id", "sold") == [(1, False), (2, True)]
    assert tuples(rejected, "id", "reason") == [(2, "buyer not found")]


def test_a_job_based_on_an_old_state_fails_whole(store, frame):
    before = store.snapshot()
    jobs.close_expired(store, NOW)
    lots = before.read("auctions").withColumn("is_active", F.lit(True))
    with pytest.raises(Conflict):
        store.commit({"auctions": lots}, base=before.version)
    assert tuples(store.read("auctions"), "is_active") == [(False,), (False,), (True,)]


def test_two_writers_never_give_one_id(store, frame):
    now = store.snapshot()
    new = frame("auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ", (1, 5, 30, "2024-01-04"))
    ours = jobs.new_rows(now, "bids", new, ["auction_id"], NOW)
    theirs = jobs.new_rows(now, "bids", new, ["auction_id"], NOW)
    store.commit(append={"bids": ours}, base=now.version)
    with pytest.raises(Conflict):
        store.commit(append={"bids": theirs}, base=now.version)
    assert tuples(store.read("bids"), "id") == [(1,), (2,), (3,)]


def test_a_writer_that_died_is_in_nobodys_way(store, monkeypatch):
    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            jobs.close_expired(store, NOW)
    assert "auction_results" not in store.tables()
    jobs.close_expired(store, NOW)
    assert store.read("auction_results").count() == 2


def test_appends_of_two_writers_are_both_kept(store, frame):
    other = SnapshotStore(store.spark, store.root)
    publish, tried = store._publish, []

    def late(version, text):
        if not tried:  # another writer comes first
            tried.append(version)
            other.commit(append={"log": frame("id BIGINT", (1,))})
        publish(version, text)

    store._publish = late
    store.commit(append={"log": frame("id BIGINT", (2,))})
    assert tuples(store.read("log"), "id") == [(1,), (2,)]
