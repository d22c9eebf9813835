from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from saleroom.operators import auctions
from tests.conftest import tuples

BID = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ"


def bid(i, auction, user, amount, second):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)
    return (i, auction, user, amount, str(at))


def test_top_bid_prefers_the_earlier_then_the_lower_id(frame):
    bids = frame(BID, bid(1, 1, 5, 50, 9), bid(2, 1, 6, 80, 8), bid(3, 1, 7, 80, 3), bid(4, 1, 8, 80, 3), bid(5, 2, 9, 1, 0))
    assert tuples(auctions.top_bid(bids), "auction_id", "user_id", "bid_amount") == [(1, 7, 80), (2, 9, 1)]
    assert tuples(auctions.current_bid(bids), "auction_id", "current_bid") == [(1, 80), (2, 1)]


def test_only_strictly_higher_bids_are_accepted(frame):
    bids = frame(BID, bid(1, 1, 5, 150, 1), bid(2, 1, 6, 200, 2), bid(3, 1, 7, 200, 3), bid(4, 1, 5, 75, 4), bid(5, 1, 6, 201, 5))
    ledger = auctions.bid_ledger(bids)
    assert tuples(ledger, "id", "accepted", "prior_amount", "prior_user_id") == [
        (1, True, None, None), (2, True, 150, 5), (3, False, 200, 6), (4, False, 200, 6), (5, True, 200, 6)
    ]
    assert {r.id for r in ledger.where("reason IS NOT NULL").collect()} == {3, 4}
    # user 6 does not outbid itself
    assert tuples(auctions.outbid_notices(bids), "bid_id", "user_id", "new_bid_amount") == [(2, 5, 200)]


def test_buy_now_rows_are_accepted_and_count(frame):
    bids = frame(
        BID + ", is_buy_now BOOLEAN", bid(1, 1, 5, 300, 1) + (False,), bid(2, 1, 6, 200, 2) + (True,),
        bid(3, 1, 7, 250, 3) + (False,), bid(4, 1, 8, 301, 4) + (None,),
    )
    assert tuples(auctions.bid_ledger(bids), "id", "accepted", "prior_user_id") == [
        (1, True, None), (2, True, 5), (3, False, 5), (4, True, 5)
    ]


def test_hot_auctions_give_the_same_ledger(spark, frame):
    rng = random.Random(3)
    rows = [bid(i, 1 if rng.random() < 0.6 else rng.randint(2, 9), rng.randint(1, 9), rng.randint(1, 500),
                rng.randint(0, 60) if i % 3 else 30) for i in range(600)]
    bids = frame(BID, *rows)
    plain = auctions.bid_ledger(bids)
    columns = ["id", "accepted", "prior_amount", "prior_user_id"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small parts are joined into one
    try:
        assert tuples(plain, *columns) == tuples(auctions.bid_ledger(bids), *columns)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    best: dict[int, tuple] = {}
    expected = []
    for i, auction, user, amount, at in sorted(rows, key=lambda r: (r[4], r[0])):
        prior = best.get(auction)
        expected.append((i, prior is None or amount > prior[0], prior and prior[0], prior and prior[1]))
        if prior is None or amount > prior[0]:
            best[auction] = (amount, user)
    assert tuples(plain, *columns) == sorted(expected, key=str)


AUCTION = "id BIGINT, end_time TIMESTAMP_NTZ, is_active BOOLEAN"


@pytest.mark.parametrize("seconds, extensions", [
    ([], 0),
    ([-61], 0),               # too early
    ([-60], 1),               # exactly one minute before
    ([0], 0),                 # at the end is too late
    ([-1, 239], 1),           # the moved end is at 300: its last minute starts at 240
    ([-1, 240], 2),
    ([-30, -20, -10], 1),     # one extension per last minute
    ([-10, 299, 599], 3),
    ([-10, 599], 1),          # a gap ends the run
])
def test_extensions(frame, seconds, extensions):
    end = dt.datetime(2024, 1, 1, 12)
    lots = frame(AUCTION, (1, str(end), True), (2, str(end), False))
    rows = [(i, a, 1, 10 + i, str(end + dt.timedelta(seconds=s))) for a in (1, 2) for i, s in enumerate(seconds)]
    bids = frame(BID, *rows) if rows else frame(BID, bid(1, 77, 1, 1, 0))
    got = auctions.extended_end_times(lots, bids).collect()
    assert [(r.auction_id, r.extensions, r.end_time) for r in got] == [
        (1, extensions, end + dt.timedelta(minutes=5 * extensions))
    ]


def test_extensions_agree_with_a_fold(frame):
    rng = random.Random(5)
    end = dt.datetime(2024, 1, 1)
    lots, rows, expected = [], [], []
    for a in range(40):
        lots.append((a, str(end), True))
        offsets = sorted(round(rng.uniform(-120, 1500), 6) for _ in range(rng.randint(0, 25)))
        current, n = 0.0, 0
        for i, s in enumerate(offsets):
            rows.append((i, a, 1, i + 1, str(end + dt.timedelta(seconds=s))))
            if 0 < current - s <= 60:
                current, n = current + 300, n + 1
        expected.append((a, n))
    got = auctions.extended_end_times(frame(AUCTION, *lots), frame(BID, *rows))
    assert tuples(got, "auction_id", "extensions") == sorted(expected, key=str)


def test_window_longer_than_step_is_refused(frame):
    lots, bids = frame(AUCTION, (1, "2024-01-01", True)), frame(BID, bid(1, 1, 1, 1, 0))
    with pytest.raises(ValueError):
        auctions.extended_end_times(lots, bids, window_seconds=600)


def test_schedule_and_expiry(frame):
    lots = frame(AUCTION, (1, "2024-01-01 00:00:10", True), (2, "2024-01-01 00:00:00", True), (3, "2023-01-01", False))
    assert tuples(auctions.schedule(lots, "2024-01-01 00:00:00"), "id", "seconds_left", "overdue") == [
        (1, 10, False), (2, 0, True)
    ]
    assert [r.id for r in auctions.expired(lots, "2024-01-01 00:00:00").collect()] == [2]


RESULT = "id BIGINT, auction_id BIGINT, winner_id BIGINT, final_bid INT, closed_at TIMESTAMP_NTZ, closed_reason STRING, is_paid BOOLEAN"


def test_outcomes_without_a_winner_stay(frame):
    results = frame(RESULT, (1, 1, None, None, "2024-01-01", "expired", None), (2, 2, 5, 9, "2024-01-01", "buy_now", True))
    faces = frame("user_id BIGINT, first_name STRING", (5, "Ann"))
    assert tuples(auctions.outcomes(results, faces), "auction_id", "closed_reason", "first_name") == [
        (1, "expired", None), (2, "buy_now", "Ann")
    ]


def test_wins_are_newest_first_with_a_real_paid_flag(frame):
    results = frame(
        RESULT, (1, 1, 5, 9, "2024-01-01", "expired", None), (2, 2, 5, 9, "2024-01-02", "expired", True),
        (3, 3, None, None, "2024-01-03", "expired", False),
    )
    lots = frame("id BIGINT, title STRING, image_urls ARRAY<STRING>, buy_now_price INT", (1, "a", [], 1), (2, "b", [], None), (3, "c", [], 1))
    got = auctions.user_wins(results, lots).collect()
    assert [(r.auction_id, r.is_paid) for r in got] == [(2, True), (1, False)]


def test_bids_carry_a_nested_profile_or_null(frame):
    bids = frame(BID, bid(1, 1, 5, 10, 0), bid(2, 1, 6, 20, 0))
    faces = frame("user_id BIGINT, first_name STRING", (5, "Ann"))
    got = auctions.bids_with_profile(bids, faces).collect()
    assert [(r.id, r.user.first_name if r.user else None) for r in got] == [(2, None), (1, "Ann")]


def test_dashboard_lists_bids_and_wins(frame):
    bids = frame(BID, bid(1, 1, 5, 10, 0), bid(2, 1, 5, 20, 9))
    results = frame(RESULT, (7, 1, 5, 20, "2024-01-03", "expired", False))
    lots = frame("id BIGINT, title STRING, image_urls ARRAY<STRING>, buy_now_price INT", (1, "a", [], 1))
    got = auctions.user_dashboard(bids, results, lots).collect()
    assert [(r.section, r.item_id) for r in got] == [("bid", 2), ("bid", 1), ("win", 7)]


def test_json_names_and_null_fields(frame):
    lots = frame("id BIGINT, image_urls ARRAY<STRING>, buy_now_price INT, end_time TIMESTAMP_NTZ", (1, ["a"], None, "2024-01-01 02:03:04"))
    assert auctions.as_json(lots).first().json == (
        '{"id":1,"imageUrls":["a"],"buyNowPrice":null,"endTime":"2024-01-01T02:03:04.000Z"}'
    )
