"""The live auction floor: late bids, chained events, state that goes."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from saleroom.session import configure, scratch_path
from saleroom.streaming import closing, live
from saleroom.streaming.runner import replay_deliveries
from tests.conftest import tuples

BID = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ"
LOT = "id BIGINT, end_time TIMESTAMP_NTZ, is_active BOOLEAN"
START = dt.datetime(2024, 1, 1)


def at(seconds: float) -> str:
    return str(START + dt.timedelta(seconds=seconds))


def floor(frame, lots, *deliveries, **how):
    ends = frame(LOT, *[(i, at(end), True) for i, end in lots])
    return replay_deliveries([frame(BID, *rows) for rows in deliveries], lambda bids: live.auction_events(bids, ends, **how), "floor")


def test_late_bids_are_placed_or_rejected_once(frame):
    first = [(1, 1, 5, 10, at(0)), (2, 3, 5, 10, at(9000))]
    second = [(3, 1, 6, 20, at(100)), (4, 2, 6, 20, at(100)), (5, 3, 6, 20, at(100)), (6, 3, 6, 5, at(110)), (7, 9, 6, 20, at(100))]
    third = [(8, 1, 7, 99, at(200)), (9, 3, 7, 99, at(50)), (10, 3, 8, 7, at(20_000))]
    got = floor(frame, [(1, 1000), (2, 30_000), (3, 40_000)], first, second, third)
    # the watermark is at 8,400 from the second delivery on: auction 1 is closed, 2 and 3 run
    assert tuples(got.where("event_name = 'bid-placed'"), "bid_id") == [(1,), (2,), (4,), (5,), (9,)]
    assert tuples(got.where("event_name = 'bid-rejected'"), "bid_id", "reason") == [
        (10, live.NOT_HIGHER), (3, "after the end"), (6, live.NOT_HIGHER), (7, "unknown auction"), (8, "after the end")
    ]
    assert tuples(got.where("event_name = 'user-outbid'"), "bid_id", "user_id") == [(5, 5), (9, 6)]
    assert tuples(got.where("event_name = 'user-won'"), "auction_id", "user_id", "bid_amount") == [(1, 5, 10)]


def test_closing_sees_late_bids(frame):
    ends = frame(LOT, (1, at(1000), True), (2, at(30_000), True))
    first, second = [(1, 1, 5, 10, at(0)), (2, 2, 5, 10, at(9000))], [(3, 1, 6, 20, at(100)), (4, 2, 6, 20, at(100)), (5, 2, 7, 1, at(50_000))]
    third = [(6, 2, 8, 30, at(200)), (7, 2, 8, 1, at(90_000))]
    got = replay_deliveries([frame(BID, *rows) for rows in (first, second, third)], lambda bids: closing.close_auctions(bids, ends), "close")
    assert tuples(got.where("kind = 'result'"), "auction_id", "user_id", "bid_amount") == [(1, 5, 10), (2, 6, 20)]
    assert tuples(got.where("kind = 'dead-letter'"), "bid_id", "reason") == [(3, "after the end"), (5, "after the end"), (6, "after the end"), (7, "after the end")]


def one_by_one(lots, deliveries, delay=600):
    """The floor, a bid at a time."""
    state, events, mark, closed = {i: [end, None, None] for i, end in lots}, [], None, set()
    for rows in deliveries:
        for b, a, u, n, t in sorted(rows, key=lambda r: (r[4], r[0])):
            if a not in state:
                events.append(("bid-rejected", a, b, None, "unknown auction"))
                continue
            end, high, holder = state[a]
            if a in closed or t >= end:
                events.append(("bid-rejected", a, b, None, "after the end"))
            elif high is not None and n <= high:
                events.append(("bid-rejected", a, b, None, live.NOT_HIGHER))
            else:
                events.append(("bid-placed", a, b, u, None))
                if holder not in (None, u):
                    events.append(("user-outbid", a, b, holder, None))
                state[a][1:] = [n, u]
                if t >= end - 60:
                    state[a][0] = end + 300
                    events.append(("auction-extended", a, b, u, None))
        mark = max([mark or 0, *(r[4] for r in rows)])
        for a, (end, high, holder) in state.items():
            if a not in closed and end < mark - delay:
                closed.add(a)
                events += [("auction-ended", a, None, None, "expired")] + ([("user-won", a, None, holder, "expired")] if holder else [])
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_like_one_bid_at_a_time(frame, seed):
    draw = random.Random(seed)
    rows = [(i, draw.randint(1, 5), draw.randint(1, 4), draw.randint(1, 400), draw.choice([draw.randint(0, 9000), draw.randint(0, 90) * 100])) for i in range(400)]
    lots = [(k, 2000 * k) for k in (1, 2, 3, 4)]
    deliveries = [[], [], []]
    for r in rows:
        deliveries[min(2, (r[4] + draw.choice([0, 0, 0, 4000])) // 3500)].append(r)
    got = floor(frame, lots, *[[(*r[:4], at(r[4])) for r in rows] for rows in deliveries])
    shown = F.when(~F.col("event_name").isin("auction-ended", "user-won"), F.col("bid_id"))
    who = F.when(~F.col("event_name").isin("bid-rejected", "auction-ended"), F.col("user_id"))
    found = tuples(got.withColumns({"bid_id": shown, "user_id": who}), "event_name", "auction_id", "bid_id", "user_id", "reason")
    assert found == sorted(one_by_one(lots, deliveries), key=str)


def test_ended_auctions_leave_the_state(spark, frame, tmp_path):
    configure(spark)
    ends = frame(LOT, (1, at(1000), True), (2, at(900_000), True))
    out, label = str(tmp_path), "state"
    for k, rows in enumerate([[(1, 1, 5, 10, at(0))], [(2, 2, 5, 10, at(5000))], [(3, 2, 6, 11, at(200_000))], [(4, 2, 6, 12, at(200_100))]]):
        frame(BID, *rows).coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = live.auction_events(spark.readStream.schema(BID).parquet(f"{out}/in"), ends, keep_hours=24)
        job = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
        job.awaitTermination()
        held = spark.read.format("statestore").option("path", f"{out}/cp").option("stateVarName", "auction").load()
        left = {r[0]: r[1] for r in held.select("key.auction_id", "value.closed").collect()}
        assert left == [{1: False, 2: False}, {1: True, 2: False}, {2: False}, {2: False}][k]
    assert scratch_path(spark, label)
