"""Live auction close: event-time timers, extensions, late bids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.ids import pinned
from saleroom.functions.time import epoch_micros
from saleroom.operators.auctions import EXTENSION_SECONDS, EXTENSION_WINDOW_SECONDS

STATE = (
    "end_us BIGINT, extensions BIGINT, amount INT, at_us BIGINT, bid_id BIGINT, user_id BIGINT, "
    "closed BOOLEAN"
)
OUTPUT = (
    "kind STRING, auction_id BIGINT, end_us BIGINT, extensions BIGINT, user_id BIGINT, "
    "bid_amount INT, bid_id BIGINT, reason STRING"
)
# How long a closed auction is remembered, so that a late bid is told why it does not count.
KEEP_CLOSED_HOURS = 24
COLUMNS = ["kind", "auction_id", "end_us", "extensions", "user_id", "bid_amount", "bid_id", "reason"]


def _whole(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, zero where null, and where they are null."""
    values = column.to_numpy()
    if values.dtype.kind != "f":
        return values.astype(np.int64, copy=False), np.zeros(len(values), bool)
    null = np.isnan(values)
    return np.where(null, 0, values).astype(np.int64), null


def opening(batch: pd.DataFrame) -> int | None:
    """The end that the first opening of a batch names."""
    at = np.flatnonzero(batch["event"].to_numpy() == "open")
    if not len(at):
        return None
    return int(batch["end_us"].to_numpy()[at[np.argmin(batch["at_us"].to_numpy()[at])]])


class Bids:
    """The bids of a batch in (created_at, id) order, as arrays."""

    def __init__(self, batch: pd.DataFrame, since_us: int | None = None) -> None:
        times, ids = batch["at_us"].to_numpy(np.int64), batch["id"].to_numpy(np.int64)
        order = np.lexsort((ids, times))
        order = order[batch["event"].to_numpy()[order] == "bid"]
        if since_us is not None:
            order = order[times[order] >= since_us]
        self.times, self.ids = times[order], ids[order]
        self.users, self.nobody = (part[order] for part in _whole(batch["user_id"]))
        self.amounts, self.no_amount = (part[order] for part in _whole(batch["bid_amount"]))


class AuctionCloser(StatefulProcessor):
    """Per auction: its current end, the top bid so far, whether it is closed."""

    def __init__(self, window_seconds: int, step_seconds: int, keep_hours: int = KEEP_CLOSED_HOURS):
        self.keep_ms = keep_hours * 3_600_000
        self.window = window_seconds * 1_000_000
        self.step = step_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", STATE)

    def _arm(self, end_us: int) -> int:
        """Set the timer for an end; timers have millisecond precision, rounded up."""
        at = -(-end_us // 1000)
        self.handle.registerTimer(at)
        return at

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._open(int(initialState["end_us"].iloc[0]))

    def _open(self, end_us: int) -> None:
        self.auction.update((end_us, 0, None, None, None, None, False))
        self._arm(end_us)

    def _shut(self, state: tuple, now_ms: int) -> None:
        """Remember that the auction is over, for a while."""
        self.auction.update((*state[:6], True))
        self.handle.registerTimer(now_ms + self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # plain arrays, one state read and one table of rows: a call is made for every auction
        batch = pd.concat(list(rows))
        opened = opening(batch)
        state = self.auction.get()
        # an opening counts for its whole micro-batch; a second one changes nothing
        if opened is not None and state is None:
            self._open(opened)
            state = (opened, 0, None, None, None, None, False)
        cancelled = batch["at_us"].to_numpy()[batch["event"].to_numpy() == "cancel"]
        gone_us = int(cancelled.min()) if len(cancelled) else None
        if gone_us is not None and state is not None and not state[6]:
            self.handle.deleteTimer(-(-state[0] // 1000))
            self._shut(state, max(gone_us // 1000, timerValues.getCurrentWatermarkInMs()))
            state = (*state[:6], True)
        # bids before the cancellation no longer matter, those after it are late
        bids = Bids(batch, gone_us)
        every = np.arange(len(bids.ids))
        if not len(every):
            return
        if state is None or state[6]:
            yield self._dead(key[0], bids, every, "unknown auction" if state is None else "after the end")
            return
        end_us, extensions, amount, at_us, bid_id, user_id, _ = state
        times = bids.times
        first_end = end_us
        while True:  # one turn per extension, not per bid
            hit = int(np.searchsorted(times, end_us - self.window, side="left"))
            if hit == len(times) or times[hit] >= end_us:
                break
            end_us += self.step
            extensions += 1
        if end_us != first_end:
            self.handle.deleteTimer(-(-first_end // 1000))
            self._arm(end_us)
        # a bid counts while its auction runs: before the end it moved to
        n = int(np.searchsorted(times, end_us, side="left"))
        if n:
            best = int(np.argmax(bids.amounts[:n]))  # the first of the highest
            rank = (-int(bids.amounts[best]), int(times[best]), int(bids.ids[best]))
            if amount is None or rank < (-amount, at_us, bid_id):
                amount, at_us, bid_id = -rank[0], rank[1], rank[2]
                user_id = int(bids.users[best])
        self.auction.update((end_us, extensions, amount, at_us, bid_id, user_id, False))
        if n < len(every):
            yield self._dead(key[0], bids, every[n:], "after the end")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.auction.get()
        if state is None:
            return
        end_us, extensions, amount, at_us, bid_id, user_id, closed = state
        if closed:
            self.auction.clear()
            return
        if expiredTimerInfo.getExpiryTimeInMs() < -(-end_us // 1000):
            return
        self._shut(state, expiredTimerInfo.getExpiryTimeInMs())
        one = {c: pd.arrays.IntegerArray(np.array([v or 0], kind), np.array([v is None])) for c, v, kind in (
            ("user_id", user_id, np.int64), ("bid_amount", amount, np.int32), ("bid_id", bid_id, np.int64),
        )}
        yield pd.DataFrame({
            "kind": ["result"], "auction_id": key[0], "end_us": end_us, "extensions": extensions, **one, "reason": "expired",
        }, columns=COLUMNS)

    @staticmethod
    def _dead(auction_id: int, bids: Bids, at: np.ndarray, reason: str) -> pd.DataFrame:
        none = pd.arrays.IntegerArray(np.zeros(len(at), np.int64), np.ones(len(at), bool))
        return pd.DataFrame({
            "kind": "dead-letter", "auction_id": auction_id, "end_us": none, "extensions": none,
            "user_id": pd.arrays.IntegerArray(bids.users[at], bids.nobody[at]),
            "bid_amount": pd.arrays.IntegerArray(bids.amounts[at].astype(np.int32), bids.no_amount[at]),
            "bid_id": bids.ids[at], "reason": reason,
        }, columns=COLUMNS)

    def close(self) -> None:
        pass


def _events(rows: DataFrame, event: str, key: str, at: str, **values: Column) -> DataFrame:
    """Rows of one kind in the common shape."""
    shape = {"id": "bigint", "user_id": "bigint", "bid_amount": "int", "end_us": "bigint"}
    return rows.select(
        F.lit(event).alias("event"), F.col(key).cast("bigint").alias("auction_id"),
        # zeros rather than nulls, which would turn whole numbers into floats on the way
        *(values.get(c, F.lit(0)).cast(kind).alias(c) for c, kind in shape.items()),
        F.col(at).cast("timestamp_ltz").alias("event_time"), epoch_micros(F.col(at)).alias("at_us"),
    )


def bid_stream(bids: DataFrame, delay: str, openings: DataFrame | None = None, cancellations: DataFrame | None = None) -> DataFrame:
    """Bids, openings and cancellations in one shape, with a watermark but without its column.

    Spark takes rows behind the watermark out of a stateful operator's input where it finds
    the watermark's column there. Without it, the watermark goes on as before and drives the
    timers, and the operator sees every row and decides by its state.
    """
    parts = [_events(bids, "bid", "auction_id", "created_at", **{c: F.col(c) for c in ("id", "user_id", "bid_amount")})]
    if openings is not None:
        parts.append(_events(openings, "open", "id", "created_at", end_us=epoch_micros(F.col("end_time"))))
    if cancellations is not None:
        parts.append(_events(cancellations, "cancel", "auction_id", "cancelled_at"))
    return reduce(DataFrame.unionByName, parts).withWatermark("event_time", delay).drop("event_time")


def close_auctions(
    bids: DataFrame,
    open_auctions: DataFrame,
    delay: str = "10 minutes",
    window_seconds: int = EXTENSION_WINDOW_SECONDS,
    step_seconds: int = EXTENSION_SECONDS,
    openings: DataFrame | None = None,
    cancellations: DataFrame | None = None,
    keep_hours: int = KEEP_CLOSED_HOURS,
) -> DataFrame:
    """Results of auctions whose end the watermark has passed, and dead-letter rows.

    The open auctions are the initial state, each with a timer at its end; a bid in the
    last minute moves the timer. `openings` is a stream of auctions that open later
    (id, end_time, created_at), `cancellations` one of auctions that were sold at once or
    deleted (auction_id, cancelled_at): these give no result. A bid from the end onward, or
    for an auction nobody opened, becomes a `dead-letter` row with its reason. At most one
    `result` per auction: the state remembers the close for `keep_hours`.

    No bid is lost: see `bid_stream`. One behind the watermark counts while its auction runs.
    """
    keyed = bid_stream(bids, delay, openings, cancellations)
    start = pinned(open_auctions.where("is_active").select(
        F.col("id").alias("auction_id"), epoch_micros(F.col("end_time")).alias("end_us")
    ))
    out = keyed.groupBy("auction_id").transformWithStateInPandas(
        AuctionCloser(window_seconds, step_seconds, keep_hours), OUTPUT, "Append", "EventTime",
        start.groupBy("auction_id"),
    )
    ended = F.timestamp_add("MICROSECOND", F.col("end_us"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return out.withColumn("end_time", ended).drop("end_us")
