from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleroom.functions.ids import numbered
from saleroom.operators import sales, users
from saleroom.plans import changes, closing, trade
from tests.conftest import tuples

NOW = "2024-01-10 12:00:00"
LOT = (
    "id BIGINT, title STRING, description STRING, image_urls ARRAY<STRING>, start_price INT, buy_now_price INT, "
    "end_time TIMESTAMP_NTZ, is_active BOOLEAN, creator_id BIGINT, updated_at TIMESTAMP_NTZ"
)
BID = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ"
RESULT = "id BIGINT, auction_id BIGINT, winner_id BIGINT"
MESSAGE = (
    "id BIGINT, conversation_id BIGINT, user_id BIGINT, message_content STRING, sent_at TIMESTAMP_NTZ, "
    "is_read BOOLEAN, is_from_admin BOOLEAN"
)
POST = "id BIGINT, title STRING, price STRING, author_id BIGINT, sold BOOLEAN, is_deleted BOOLEAN"


def lot(i, end, active=True, buy=200):
    return (i, f"lot {i}", "d", ["http://h/img1.jpg", "http://h/img2.jpg", "http://h/img3.jpg"], 100, buy, end, active, 1, "2023-01-01")


@pytest.fixture
def lots(frame):
    return frame(LOT, lot(1, "2024-01-10 11:50:00"), lot(2, NOW), lot(3, "2024-01-10 12:15:00", buy=None), lot(4, "2024-01-01", active=False))


@pytest.fixture
def bids(frame):
    return frame(BID, (1, 1, 5, 50, "2024-01-02"), (2, 1, 6, 80, "2024-01-03"), (3, 3, 5, 10, "2024-01-03"), (4, 4, 5, 10, "2024-01-03"))


@pytest.fixture
def talk(frame):
    return frame(MESSAGE, (1, 3, 6, "a", "2024-01-01", True, False), (2, 9, 6, "b", "2024-01-02", True, False))


def test_the_sweep_closes_what_is_due(lots, bids, talk):
    done = closing.close_expired(lots, bids, talk, NOW)
    assert tuples(done.results, "auction_id", "winner_id", "final_bid", "closed_reason") == [
        (1, 6, 80, "expired"), (2, None, None, "expired")
    ]
    assert tuples(done.notifications, "user_id", "auction_id", "type") == [(6, 1, "won")]
    assert tuples(done.messages, "user_id", "conversation_id", "is_from_admin") == [(6, 3, True)]
    assert tuples(done.auctions, "id", "is_active") == [(1, False), (2, False), (3, True), (4, False)]
    assert {r.id for r in done.auctions.where(F.col("updated_at") > "2024-01-01").collect()} == {1, 2}


def test_a_second_sweep_adds_nothing(lots, bids, talk, frame):
    done = closing.close_expired(lots, bids, talk, NOW)
    assert closing.close_expired(done.auctions, bids, talk, NOW).results.count() == 0
    known = frame(RESULT, (1, 1, 6), (2, 2, None))
    assert closing.close_expired(lots, bids, talk, NOW, known).results.count() == 0


def test_winners_without_a_conversation_get_one_each(lots, frame, talk):
    bids = frame(BID, (1, 1, 8, 50, "2024-01-02"), (2, 2, 8, 80, "2024-01-03"))
    done = closing.close_expired(lots, bids, talk, NOW)
    assert tuples(done.messages, "auction_id", "conversation_id") == [(1, 10), (2, 10)]


def test_buy_now(lots, talk, frame):
    requests = frame(
        "id BIGINT, auction_id BIGINT, user_id BIGINT, created_at TIMESTAMP_NTZ",
        (1, 1, 6, "2024-01-05"), (2, 1, 5, "2024-01-04"), (3, 3, 5, "2024-01-04"), (4, 4, 5, "2024-01-04"), (5, 2, 6, "2024-01-04"),
    )
    done = closing.buy_now(lots, requests, talk, NOW)
    # 3 has no price, 4 is closed
    assert tuples(done.results, "auction_id", "winner_id", "final_bid", "closed_reason") == [
        (1, 5, 200, "buy_now"), (2, 6, 200, "buy_now")
    ]
    assert tuples(done.bids, "auction_id", "user_id", "bid_amount") == [(1, 5, 200), (2, 6, 200)]
    assert done.notifications is None
    # the buyer's highest conversation, or a new one
    assert tuples(done.messages, "user_id", "conversation_id") == [(5, 10), (6, 9)]
    assert tuples(done.auctions, "id", "is_active") == [(1, False), (2, False), (3, True), (4, False)]


def test_swap_makes_a_listing_with_images(lots, frame):
    posts = frame(POST, (41, "x", "1", 1, False, False))
    new = trade.swap_to_listings(lots.where("id IN (1, 3)"), posts, NOW)
    assert tuples(new, "id", "auction_id", "price", "num_imgs", "public_id", "sold") == [
        (42, 1, "200", 3, "img1.jpg", False), (43, 3, "100", 3, "img1.jpg", False)
    ]
    images = trade.swap_images(lots.where("id = 1"), new)
    assert tuples(images, "post_id", "position", "public_id") == [(42, 0, "img1.jpg"), (42, 1, "img2.jpg"), (42, 2, "img3.jpg")]


def test_a_zero_buy_now_price_falls_back(frame):
    free = frame(LOT, lot(1, NOW, buy=0))
    new = trade.swap_to_listings(free, frame(POST, (1, "x", "1", 1, False, False)).where("id < 0"), NOW)
    assert tuples(new, "id", "price") == [(1, "100")]


def test_delete_follows_children_and_grandchildren(lots, bids, frame):
    tables = {
        "users": frame("id BIGINT, email STRING", (1, "a"), (5, "b"), (6, "c")),
        "auctions": lots.withColumn("creator_id", F.when(F.col("id") == 1, 5).otherwise(1).cast("bigint")),
        "bids": bids,
        "profiles": frame("id BIGINT, user_id BIGINT", (1, 5), (2, 6)),
    }
    kept = changes.delete(tables, "users", frame("id BIGINT", (5,)))
    assert tuples(kept["users"], "id") == [(1,), (6,)]
    assert tuples(kept["profiles"], "user_id") == [(6,)]
    assert tuples(kept["auctions"], "id") == [(2,), (3,), (4,)]
    # user 5's bids, and bid 2 of user 6 because auction 1 goes
    assert kept["bids"].count() == 0


def test_delete_auction_and_results(lots, bids, frame):
    tables = {"auctions": lots, "bids": bids, "auction_results": frame(RESULT, (1, 4, 5), (2, 1, 6))}
    kept = changes.delete(tables, "auctions", frame("id BIGINT", (4,)), also={"auction_results": "auction_id"})
    assert tuples(kept["auctions"], "id") == [(1,), (2,), (3,)]
    assert tuples(kept["bids"], "id") == [(1,), (2,), (3,)]
    assert tuples(kept["auction_results"], "auction_id") == [(1,)]


def test_patch_keeps_on_null_and_overwrite_does_not(frame):
    rows = frame("id BIGINT, a STRING, b STRING, creator_id BIGINT", (1, "a1", "b1", 7), (2, "a2", "b2", 7))
    edits = frame("id BIGINT, a STRING, b STRING", (1, None, "new"))
    patched = changes.patch(rows, edits, always={"creator_id": F.lit(1).cast("bigint")})
    assert tuples(patched, "id", "a", "b", "creator_id") == [(1, "a1", "new", 1), (2, "a2", "b2", 7)]
    assert tuples(changes.overwrite(rows, edits), "id", "a", "b") == [(1, None, "new"), (2, "a2", "b2")]


def test_the_last_change_of_a_key_wins(frame):
    rows = frame("id BIGINT, a STRING", (1, "old"))
    edits = frame("seq BIGINT, id BIGINT, a STRING", (2, 1, "second"), (1, 1, "first"), (3, 1, None))
    assert tuples(changes.overwrite(rows, edits, order=["seq"]), "a") == [(None,)]


def test_counters_and_flags(frame):
    people = frame("id BIGINT, is_verified BOOLEAN, version INT", (1, False, 1), (2, False, 4))
    got = changes.set_where(people, frame("k BIGINT", (2,), (2,)), {"is_verified": F.lit(True), "version": F.col("version") + 1})
    assert tuples(got, "id", "is_verified", "version") == [(1, False, 1), (2, True, 5)]


ADDRESS = (
    "id BIGINT, user_id BIGINT, address_line1 STRING, address_line2 STRING, city STRING, state STRING, "
    "postal_code STRING, country_code STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)


def test_address_upsert_updates_the_newest_and_inserts_with_defaults(frame):
    current = frame(
        ADDRESS,
        (1, 5, "old", "apt", "c", "s", "p", "CA", "2024-01-01", "2024-01-01"),
        (2, 5, "newest", "apt", "c", "s", "p", "CA", "2024-01-02", "2024-01-02"),
    )
    new = frame("user_id BIGINT, address_line1 STRING, address_line2 STRING, city STRING, state STRING, postal_code STRING",
                (5, "5 street", None, "x", "y", "z"), (6, "6 street", None, "x", "y", "z"))
    got = changes.upsert_addresses(current, new, NOW)
    assert tuples(got, "id", "user_id", "address_line1", "address_line2", "country_code") == [
        (1, 5, "old", "apt", "CA"), (2, 5, "5 street", None, "US"), (3, 6, "6 street", None, "US")
    ]
    assert {r.id: str(r.updated_at) for r in got.collect()}[2] == NOW
    assert {r.id: str(r.created_at) for r in got.collect()} == {1: "2024-01-01 00:00:00", 2: "2024-01-02 00:00:00", 3: NOW}


def test_append_numbers_in_order_and_fills_defaults(frame):
    current = frame("id BIGINT, user_id BIGINT, type STRING, created_at TIMESTAMP_NTZ, is_read BOOLEAN", (7, 1, "won", "2024-01-01", True))
    new = frame("user_id BIGINT, type STRING, is_read BOOLEAN", (9, "won", None), (8, "outbid", True))
    got = changes.append(current, new, "notifications", ["user_id"], NOW)
    assert tuples(got, "id", "user_id", "is_read") == [(7, 1, True), (8, 8, True), (9, 9, False)]
    assert str(got.where("id = 8").first().created_at) == NOW


def test_numbering_is_dense_over_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).selectExpr("id", "(id * 7919) % 5000 AS k")
    got = numbered(rows, ["k"], "n")
    assert got.where("n <> k + 1").count() == 0
    assert got.count() == 5000


def test_paid_follows_its_flag(frame):
    rows = frame("id BIGINT, is_paid BOOLEAN, paid_at TIMESTAMP_NTZ", (1, False, None), (2, True, "2024-01-01"), (3, True, "2024-01-01"))
    got = changes.mark_paid(rows, frame("id BIGINT, is_paid BOOLEAN", (1, True), (2, False)), NOW)
    assert [(a, b, str(c)) for a, b, c in tuples(got, "id", "is_paid", "paid_at")] == [
        (1, True, NOW), (2, False, "None"), (3, True, "2024-01-01 00:00:00")
    ]


def test_soft_delete_keeps_the_row(frame):
    got = changes.soft_delete(frame(POST, (1, "x", "1", 1, False, False), (2, "y", "1", 1, False, False)), frame("id BIGINT", (2,)), NOW)
    assert [(a, b, str(c)) for a, b, c in tuples(got, "id", "is_deleted", "deleted_at")] == [(1, False, "None"), (2, True, NOW)]


def test_mark_read(frame):
    notes = frame("id BIGINT, user_id BIGINT, is_read BOOLEAN", (1, 5, False), (2, 6, False))
    assert tuples(changes.mark_notifications_read(notes, frame("u BIGINT", (5,))), "id", "is_read") == [(1, True), (2, False)]
    assert tuples(changes.mark_messages_read(notes, frame("i BIGINT", (2,))), "id", "is_read") == [(1, False), (2, True)]


def test_sales_are_recorded_and_listings_marked(frame):
    posts = frame(POST, (1, "x", "1", 1, False, False), (2, "y", "1", 1, None, False))
    people = frame("id BIGINT, email STRING", (5, "five@x"))
    requests = frame(
        "id BIGINT, post_id BIGINT, buyer_email STRING, price STRING, tracking STRING",
        (1, 1, "five@x", "99.99", ""), (2, 2, "nobody@x", "1.00", "T"), (3, None, "five@x", "1.00", "T"), (4, 2, "five@x", None, "T"),
    )
    new, listings, rejected = trade.record_sales(requests, people, posts, NOW)
    assert [(str(p), b, t, paid) for p, b, t, paid in tuples(new, "price", "buyer_id", "tracking_number", "is_paid")] == [("99.99", 5, None, False)]
    assert tuples(listings, "id", "sold") == [(1, True), (2, None)]
    assert tuples(rejected, "id", "reason") == [(2, "buyer not found"), (3, "post_id is required"), (4, "price is required")]


def test_discount_and_undo(frame):
    posts = frame(
        POST + ", original_price STRING, discounted_price STRING",
        (1, "x", "200", 1, False, False, "500", "450"), (2, "y", "ask", 1, False, False, None, None),
        (3, "z", "90.10", 2, False, False, "95", "90.10"), (4, "w", "90.10", None, False, False, "95", "90.10"),
    )
    got = trade.apply_discount(posts, 1, 15)
    shown = got.withColumn("shown", trade.price_text(F.col("discounted_price")))
    # the stored original is replaced by the current price
    assert tuples(shown, "id", "original_price", "shown") == [(1, "200", "170"), (2, "ask", None), (3, "95", "90.1"), (4, "95", "90.1")]
    undone = trade.undo_discount(got, 1).withColumn("shown", trade.price_text(F.col("discounted_price")))
    assert tuples(undone, "id", "original_price", "shown") == [(1, None, None), (2, None, None), (3, "95", "90.1"), (4, "95", "90.1")]


def test_edits_reset_the_original_price(frame):
    posts = frame("id BIGINT, title STRING, price STRING, original_price STRING", (1, "x", "1", None))
    got = trade.edit_listings(posts, frame("id BIGINT, title STRING, price STRING", (1, None, "7")))
    assert tuples(got, "title", "price", "original_price") == [(None, "7", "7")]


SALE = "id BIGINT, post_id BIGINT, buyer_id BIGINT, price DECIMAL(10,2), is_paid BOOLEAN, created_at TIMESTAMP_NTZ"


def test_sales_report_and_buyer_lists(spark, frame):
    rows = frame(SALE.replace("DECIMAL(10,2)", "STRING"), (1, 1, 5, "10.00", False, "2024-01-01"), (2, 1, 6, "5.50", True, "2024-01-02"),
                 (3, 1, 7, "1.00", False, "2024-01-03")).withColumn("price", F.col("price").cast("decimal(10,2)"))
    posts = frame("id BIGINT, title STRING, image_url STRING, price STRING", (1, "x", "i", "11"))
    people = frame("id BIGINT, email STRING", (5, "five@x"), (6, "six@x"), (7, "seven@x"))
    faces = frame("user_id BIGINT, first_name STRING, last_name STRING", (5, "F", "Ive"), (6, "S", None))
    got = sales.report(rows, posts, people, faces)
    assert [(r.id, r.buyer_name) for r in got.collect()] == [(2, None), (1, "F Ive")]
    assert [r.id for r in sales.buyer_sales(rows, posts, 5).collect()] == [1]
    assert sales.buyer_sales(rows, posts, 99).count() == 0
    assert [(b, str(o)) for b, o in tuples(sales.outstanding_by_buyer(rows), "buyer_id", "outstanding")] == [(5, "10.00"), (7, "1.00")]


def test_users(frame):
    people = frame("id BIGINT, email STRING", (1, "a"), (2, "b"), (3, "c"))
    faces = frame("user_id BIGINT, first_name STRING, created_at TIMESTAMP_NTZ", (1, "A", "2024-01-01"), (2, "B", "2024-01-02"))
    # a missing profile date comes first
    assert [r.id for r in users.by_profile_date(people, faces).collect()] == [3, 2, 1]
    homes = frame("id BIGINT, user_id BIGINT, city STRING, created_at TIMESTAMP_NTZ",
                  (1, 1, "old", "2024-01-01"), (2, 1, "tie", "2024-01-02"), (3, 1, "tie later", "2024-01-02"), (4, 1, "undated", None))
    assert tuples(users.latest_address(homes), "user_id", "city") == [(1, "tie later")]
    rows = users.directory(people, faces, homes).orderBy("id").collect()
    assert [(r.id, r.profile and r.profile.first_name, r.address and r.address.city) for r in rows] == [
        (1, "A", "tie later"), (2, "B", None), (3, None, None)
    ]
    assert [r.id for r in users.addresses_by_user(homes, 1).collect()][0] == 4


def test_partial_addresses(frame):
    rows = frame("id BIGINT, address_line1 STRING, city STRING, state STRING, postal_code STRING",
                 (1, "a", "b", "c", "d"), (2, "a", " ", "c", None), (3, "", None, " ", " "))
    assert tuples(users.address_quality(rows), "id", "quality") == [(1, "complete"), (2, "partial"), (3, "none")]


def test_replaced_profile_images(frame):
    old = frame("user_id BIGINT, image_url STRING", (1, "http://h/a.jpg"), (2, "http://h/b.jpg"), (3, None), (4, "http://h/d.jpg"))
    new = frame("user_id BIGINT, image_url STRING", (1, "http://h/new.jpg"), (2, "http://h/b.jpg"), (3, "http://h/c.jpg"))
    assert tuples(users.replaced_images(old, new), "user_id", "storage_key") == [(1, "a.jpg")]
