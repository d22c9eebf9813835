"""A live auction floor: from bids to the events that are fanned out, in one stateful query.

Each auction's state holds its end, the highest accepted bid and who placed it. Bids are
judged, ends moved and auctions closed by it, so the events follow from one another and not
from separate jobs: `bid-placed`, `user-outbid`, `auction-extended`, `auction-ended`,
`user-won`; and `bid-rejected` with a reason for every bid that is not placed.

No bid is lost. Spark drops rows behind the watermark only where the watermark's column
reaches the stateful operator; here that column ends before it. So the watermark still drives
the timers, and a bid of any age is judged by the state: it is placed if its auction has not
been closed, however late it comes, and rejected otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.ids import pinned
from saleroom.functions.time import epoch_micros
from saleroom.operators.auctions import EXTENSION_SECONDS, EXTENSION_WINDOW_SECONDS
from saleroom.streaming.closing import KEEP_CLOSED_HOURS, Bids, bid_stream, opening
from saleroom.streaming.fanout import fan_out

STATE = "end_us BIGINT, amount INT, bid_id BIGINT, user_id BIGINT, closed BOOLEAN"
EVENT = "event_name STRING, auction_id BIGINT, user_id BIGINT, bid_id BIGINT, bid_amount INT, end_us BIGINT, at_us BIGINT, reason STRING"
COLUMNS = [part.split()[0] for part in EVENT.split(", ")]
NOT_HIGHER = "not higher than the current bid"


class AuctionFloor(StatefulProcessor):
    """Per auction: its end, the highest bid, whether it is closed."""

    def __init__(self, window_seconds: int, step_seconds: int, keep_hours: int = KEEP_CLOSED_HOURS) -> None:
        self.window, self.step, self.keep_ms = window_seconds * 1_000_000, step_seconds * 1_000_000, keep_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.auction = handle.getValueState("auction", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._open(int(initialState["end_us"].iloc[0]))

    def _open(self, end_us: int) -> None:
        self.auction.update((end_us, None, None, None, False))
        self.handle.registerTimer(-(-end_us // 1000))

    @staticmethod
    def _shown(auction: int, names: list[str] | np.ndarray, reason: object, **values: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        """Events as one table; each value comes with its mask of nulls."""
        return pd.DataFrame({
            "event_name": names, "auction_id": auction, **{c: pd.arrays.IntegerArray(*v) for c, v in values.items()}, "reason": reason,
        }, columns=COLUMNS, copy=False)

    def _events(self, auction: int, bids: Bids, found: list[tuple]) -> pd.DataFrame:
        """One table of all events: each found as (name, places of its bids, users, ends, reason)."""
        counts = [len(at) for _, at, *_ in found]
        at = np.concatenate([at for _, at, *_ in found])
        users = [bids.users[at] if of is None else of for _, at, of, *_ in found]
        ends = [np.zeros(n, np.int64) if end is None else end for n, (*_, end, _) in zip(counts, found)]
        none = np.zeros(len(at), bool)
        return self._shown(
            auction, np.repeat(np.array([name for name, *_ in found], object), counts),
            np.concatenate([np.broadcast_to(np.asarray(why, object), n) for n, (*_, why) in zip(counts, found)]),
            user_id=(np.concatenate(users), np.concatenate([bids.nobody[at] if of is None else np.zeros(len(at), bool) for _, at, of, *_ in found])),
            bid_id=(bids.ids[at], none), bid_amount=(bids.amounts[at].astype(np.int32), bids.no_amount[at]),
            end_us=(np.concatenate(ends), np.repeat([end is None for *_, end, _ in found], counts)), at_us=(bids.times[at], none),
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # plain arrays, one state read and one table of events: a call is made for every auction
        batch = pd.concat(list(rows))
        opened = opening(batch)
        state = self.auction.get()
        if opened is not None and state is None:  # counts for its whole micro-batch
            self._open(opened)
            state = (opened, None, None, None, False)
        bids = Bids(batch)
        every = np.arange(len(bids.ids))
        if not len(every):
            return
        if state is None or state[4]:
            yield self._events(key[0], bids, [("bid-rejected", every, None, None, "unknown auction" if state is None else "after the end")])
            return
        end_us, amount, bid_id, user_id, _ = state
        times, amounts = bids.times, np.where(bids.no_amount, np.iinfo(np.int64).min, bids.amounts)
        floor = np.iinfo(np.int64).min if amount is None else amount
        before = np.maximum.accumulate(np.concatenate([[floor], amounts]))[:-1]
        rises = np.flatnonzero(amounts > before)
        # ends only move up, so one pass over the rises, with a turn per extension, finds them all
        first_end, moved, ends, at = end_us, [], [], 0
        while at < len(rises) and times[rises[at]] < end_us:
            at += int(np.searchsorted(times[rises[at:]], end_us - self.window, side="left"))
            if at < len(rises) and times[rises[at]] < end_us:
                end_us += self.step
                moved.append(rises[at])
                ends.append(end_us)
                at += 1
        in_time = times < end_us
        placed = rises[in_time[rises]]
        is_placed = np.zeros(len(every), bool)
        is_placed[placed] = True
        refused = every[~is_placed]
        found = []
        if len(refused):
            found.append(("bid-rejected", refused, None, None, np.where(in_time[refused], NOT_HIGHER, "after the end").astype(object)))
        if len(placed):
            found.append(("bid-placed", placed, None, None, None))
            # who held the auction before each placed bid
            users, held = bids.users[placed], np.concatenate([[0 if user_id is None else user_id], bids.users[placed[:-1]]])
            lost = held != users
            lost[0] &= user_id is not None
            if lost.any():
                found.append(("user-outbid", placed[lost], held[lost], None, None))
            if moved:
                found.append(("auction-extended", np.array(moved), None, np.array(ends, np.int64), None))
                self.handle.deleteTimer(-(-first_end // 1000))
                self.handle.registerTimer(-(-end_us // 1000))
            last = placed[-1]
            self.auction.update((end_us, int(amounts[last]), int(bids.ids[last]), int(bids.users[last]), False))
        yield self._events(key[0], bids, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.auction.get()
        if state is None:
            return
        end_us, amount, bid_id, user_id, closed = state
        if closed:  # remembered long enough
            self.auction.clear()
            return
        if expiredTimerInfo.getExpiryTimeInMs() < -(-end_us // 1000):
            return
        self.auction.update((end_us, amount, bid_id, user_id, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        names = ["auction-ended"] + ["user-won"] * (user_id is not None)
        n = len(names)
        some = {c: (np.full(n, v or 0, kind), np.full(n, v is None)) for c, v, kind in (
            ("user_id", user_id, np.int64), ("bid_id", bid_id, np.int64), ("bid_amount", amount, np.int32),
            ("end_us", end_us, np.int64), ("at_us", end_us, np.int64),
        )}
        yield self._shown(key[0], names, "expired", **some)

    def close(self) -> None:
        pass


def _moment(us: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01").cast("timestamp_ntz"))


def auction_events(
    bids: DataFrame,
    open_auctions: DataFrame,
    delay: str = "10 minutes",
    window_seconds: int = EXTENSION_WINDOW_SECONDS,
    step_seconds: int = EXTENSION_SECONDS,
    openings: DataFrame | None = None,
    keep_hours: int = KEEP_CLOSED_HOURS,
) -> DataFrame:
    """event_name, auction_id, user_id, bid_id, bid_amount, end_time, event_at, reason of everything that happens.

    Within a micro-batch bids are judged in (created_at, id) order; a later micro-batch is
    judged against the state. An accepted bid in the last minute moves the end. `user_id` is
    whom the event is about: the bidder, the user outbid, the winner.
    """
    start = pinned(open_auctions.where("is_active").select(F.col("id").alias("auction_id"), epoch_micros(F.col("end_time")).alias("end_us")))
    out = bid_stream(bids, delay, openings).groupBy("auction_id").transformWithStateInPandas(
        AuctionFloor(window_seconds, step_seconds, keep_hours), EVENT, "Append", "EventTime", start.groupBy("auction_id")
    )
    return out.select(
        "event_name", "auction_id", "user_id", "bid_id", "bid_amount", _moment("end_us").alias("end_time"), _moment("at_us").alias("event_at"), "reason"
    )


def fanned_out(events: DataFrame) -> DataFrame:
    """The events of the floor with the rooms they go to; rejected bids go nowhere."""
    shaped = events.withColumns({"conversation_id": F.lit(None).cast("bigint"), "is_from_admin": F.lit(None).cast("boolean")})
    return fan_out(shaped).drop("conversation_id", "is_from_admin")
