"""What a call for one auction costs: one read of its state, one table of rows."""

from __future__ import annotations

import pandas as pd
import pytest

from saleroom.streaming.closing import AuctionCloser
from saleroom.streaming.live import NOT_HIGHER, AuctionFloor


class State:
    def __init__(self, value):
        self.value, self.reads = value, 0

    def get(self):
        self.reads += 1
        return self.value

    def exists(self):
        self.reads += 1
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class Timer:
    def getExpiryTimeInMs(self):
        return 10**9


MINUTE = 60_000_000
ROWS = [(5, 10, 0, 1), (6, 20, 10, 2), (None, 15, 20, 3), (7, 30, 9 * MINUTE + 1, 4), (8, 99, 16 * MINUTE, 5)]


def called(processor, value):
    processor.handle, processor.auction = Handle(), State(value)
    rows = pd.DataFrame(
        [("bid", 1, i, user, amount, 0, at) for user, amount, at, i in ROWS], columns=["event", "auction_id", "id", "user_id", "bid_amount", "end_us", "at_us"]
    )
    shown = list(processor.handleInputRows((1,), iter([rows[:2], rows[2:]]), None))
    assert processor.auction.reads == 1 and len(shown) == 1
    processor.auction.reads = 0
    ended = list(processor.handleExpiredTimer((1,), None, Timer())) if value else []
    assert processor.auction.reads <= 1
    return shown[0], ended


def test_the_floor_reads_once_and_shows_one_table():
    shown, (ended,) = called(AuctionFloor(60, 300), (10 * MINUTE, None, None, None, False))
    found = sorted(zip(shown["event_name"], shown["bid_id"], shown["user_id"].fillna(-1), shown["reason"].fillna("")))
    assert found == [
        ("auction-extended", 4, 7, ""), ("bid-placed", 1, 5, ""), ("bid-placed", 2, 6, ""), ("bid-placed", 4, 7, ""),
        ("bid-rejected", 3, -1, NOT_HIGHER), ("bid-rejected", 5, 8, "after the end"), ("user-outbid", 2, 5, ""), ("user-outbid", 4, 6, ""),
    ]
    assert shown["end_us"].dropna().tolist() == [15 * MINUTE]
    assert list(zip(ended["event_name"], ended["user_id"], ended["end_us"])) == [("auction-ended", 7, 15 * MINUTE), ("user-won", 7, 15 * MINUTE)]


def test_the_closer_reads_once_and_shows_one_table():
    shown, (ended,) = called(AuctionCloser(60, 300), (10 * MINUTE, 0, None, None, None, None, False))
    assert list(zip(shown["kind"], shown["bid_id"], shown["reason"])) == [("dead-letter", 5, "after the end")]
    assert list(zip(ended["kind"], ended["user_id"], ended["bid_amount"], ended["extensions"])) == [("result", 7, 30, 1)]


@pytest.mark.parametrize("make", [AuctionFloor, AuctionCloser])
def test_an_unknown_auction(make):
    shown, _ = called(make(60, 300), None)
    assert shown["reason"].tolist() == ["unknown auction"] * 5 and shown["bid_id"].tolist() == [1, 2, 3, 4, 5]
