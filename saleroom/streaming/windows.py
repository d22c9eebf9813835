"""Rate-limit audit and typing sessions over event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.cooldown import counted
from saleroom.functions.skew import in_parts, with_last_link
from saleroom.functions.time import epoch_micros

# Permitted hits and window length per kind of limit.
LIMITS = {
    "requests": (3000, "15 minutes"),
    "requests in test": (150, "1 minute"),
    "mail actions": (3, "1 hour"),
}
NO_EMAIL = "no-email"


def email_key(email: Column) -> Column:
    """Lower-cased e-mail; one shared key for requests without one."""
    return F.coalesce(F.lower(F.nullif(email, F.lit(""))), F.lit(NO_EMAIL))


def hits_per_window(events: DataFrame, key: Column, window: str, delay: str = "10 minutes") -> DataFrame:
    """Hits per key and tumbling window. Works on a batch and on a stream (update mode)."""
    timed = events.withColumn("event_time", F.col("ts").cast("timestamp_ltz"))
    if events.isStreaming:
        timed = timed.withWatermark("event_time", delay)
    counted = timed.groupBy(key.alias("key"), F.window("event_time", window)).agg(
        F.count("*").alias("hits")
    )
    return counted.select("key", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "hits")


def limit_audit(events: DataFrame, key: Column, kind: str) -> DataFrame:
    """Hits per key and window of one kind of limit; `over_limit` keeps those beyond it."""
    return hits_per_window(events, key, LIMITS[kind][1])


def over_limit(hits: DataFrame, limit: int) -> DataFrame:
    """Windows in which a key made more than `limit` hits, and by how many."""
    return hits.where(F.col("hits") > limit).withColumn("excess", F.col("hits") - limit)


# ---- windows from a key's first hit -----------------------------------------------------
#
# A limiter opens a window at a key's first hit, [start, start + length), and the next one at
# the first hit after it. Both forms below give (key, window_start, hits).


def hits_since_first(hits: DataFrame, key: Column, seconds: int, at: str = "ts") -> DataFrame:
    """All windows of a batch of hits, whatever their order.

    Hits are added up per key and time (combined map-side) and cut into even parts by
    (key, time), so that the one key of all requests without an e-mail fills many parts. A part
    states how the chain of windows goes on through it; given the window it begins in, it counts
    its own hits, and a window over several parts is added up from a row of each.
    Hits without a time are no hits; a null key is a key.
    """
    gap = seconds * 1_000_000 - 1  # a hit at the very end opens the next window
    timed = hits.where(F.col(at).isNotNull()).select(key.alias("_k"), epoch_micros(F.col(at)).alias("_t"))
    parts = in_parts(timed.groupBy("_k", "_t").agg(F.count("*").alias("_n")), ["_k", "_t"])
    kind = dict(parts.dtypes)["_k"]
    found = with_last_link(parts, gap).select("_k", "_t", "_n", "_last").mapInArrow(
        counted(gap), f"_k {kind}, _start bigint, _n bigint"
    )
    return found.groupBy(F.col("_k").alias("key"), _time("_start").alias("window_start")).agg(F.sum("_n").alias("hits"))


def _time(micros: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(micros), F.lit("1970-01-01").cast("timestamp_ntz"))


class FirstHitWindows(StatefulProcessor):
    """Per key: start and hits of the open window, until the watermark has passed its end."""

    def __init__(self, length_us: int):
        self.length = length_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_us BIGINT, hits BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["at_us"].to_numpy(dtype=np.int64) for part in rows]))
        start, hits = self.open.get() if self.open.exists() else (int(times[0]), 0)
        earlier, found, at = start, [], 0
        while True:  # one turn per window
            end = int(np.searchsorted(times, start + self.length, side="left"))
            hits += end - at
            if end > at:
                found.append((key[0], start, hits))
            at = end
            if at == len(times):
                break
            start, hits = int(times[at]), 0
        if self.open.exists() and start != earlier:
            self.handle.deleteTimer(self._over(earlier))
        self.open.update((start, hits))
        self.handle.registerTimer(self._over(start))
        yield pd.DataFrame(found, columns=["key", "start_us", "hits"])

    def _over(self, start_us: int) -> int:
        return (start_us + self.length) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self._over(self.open.get()[0]):
            self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_hits_since_first(hits: DataFrame, key: Column, seconds: int, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The windows of a stream of hits, counted in order of arrival as a limiter does.

    Every micro-batch gives the windows it touched with their hits so far; the largest count is
    the latest. Within a micro-batch hits are put in order. A hit from before the open window
    counts in it. No hit is dropped; a key's state goes when the watermark has passed its window.
    """
    timed = hits.where(F.col(at).isNotNull()).withColumn("_event", F.col(at).cast("timestamp_ltz")).withWatermark("_event", delay)
    # without the watermark's column in it, Spark takes no late rows out of the operator's input
    keyed = timed.select(key.alias("key"), epoch_micros(F.col(at)).alias("at_us"))
    kind = dict(keyed.dtypes)["key"]
    found = keyed.groupBy("key").transformWithStateInPandas(
        FirstHitWindows(seconds * 1_000_000), f"key {kind}, start_us BIGINT, hits BIGINT", "Append", "EventTime"
    )
    return found.select("key", _time("start_us").alias("window_start"), "hits")


KEY = ["nulls", "conversation_id", "user_id"]
SESSION = "nulls INT, conversation_id BIGINT, user_id BIGINT, start_us BIGINT, last_us BIGINT, n_events BIGINT, ended_by STRING"
OPEN = ["start_us", "last_us", "n_events"]
# State is kept per bucket of writers: a call, a state value and a timer for each writer would cost more than the work.
BUCKETS = 1024


class TypingSessions(StatefulProcessor):
    """Per bucket of conversations and users: the open bursts of typing, one at most of each."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = ", ".join(f"{c} ARRAY<BIGINT>" for c in KEY + OPEN)
        self.open = handle.getValueState("open", f"timer_ms BIGINT, {lists}")

    def _held(self) -> tuple[int | None, pd.DataFrame]:
        """The timer and the open bursts."""
        timer, *lists = self.open.get() if self.open.exists() else (None, *([] for _ in KEY + OPEN))
        return timer, pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(KEY + OPEN, lists)})

    def _due(self, last_us: np.ndarray) -> np.ndarray:
        """When bursts are over, in milliseconds."""
        return (last_us + self.gap) // 1000 + 1

    def _hold(self, timer: int | None, bursts: pd.DataFrame) -> None:
        """Keep the open bursts, with a timer for the one that ends first."""
        first = int(self._due(bursts["last_us"].to_numpy()).min()) if len(bursts) else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.open.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.open.update((first, *(bursts[c].tolist() for c in KEY + OPEN)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        seen = pd.concat(list(rows))
        # open bursts come first in their group, as one row each
        both = pd.concat([
            held.assign(at_us=held["last_us"], id=0, is_stop=False, event=False),
            seen[[*KEY, "at_us", "id", "is_stop"]].assign(start_us=seen["at_us"], last_us=seen["at_us"], n_events=1, event=True),
        ]).sort_values([*KEY, "event", "at_us", "id"], kind="stable")
        keys = both[KEY].to_numpy(np.int64)
        start, last, n = (both[c].to_numpy(np.int64) for c in OPEN)
        stops, event = both["is_stop"].to_numpy(bool), both["event"].to_numpy(bool)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        # an event from before the open burst's end joins it
        opened = np.where(event[new], np.iinfo(np.int64).min, start[new])[group]
        start, times = np.maximum(start, opened), np.maximum(last, opened)
        # a new burst begins after a stop, after an idle gap, or when none is open
        begins = new | np.concatenate([[False], (np.diff(times) > self.gap) | stops[:-1]])
        at = np.flatnonzero(begins)
        stop = np.logical_or.reduceat(stops, at)
        bursts = pd.DataFrame({
            **dict(zip(KEY, keys[at].T)), "start_us": np.minimum.reduceat(start, at), "last_us": np.maximum.reduceat(times, at),
            "n_events": np.add.reduceat(n, at), "ended_by": np.where(stop, "stop", "idle"),
        })
        newest = np.concatenate([group[at][1:] != group[at][:-1], [True]])
        stay_open = newest & ~stop
        self._hold(timer, bursts[stay_open])
        if not stay_open.all():
            yield bursts[~stay_open]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if expired != timer:
            return
        due = self._due(held["last_us"].to_numpy())
        over = (due <= expired) | (due < timerValues.getCurrentWatermarkInMs())
        self._hold(timer, held[~over])
        yield held[over].assign(ended_by="idle")

    def close(self) -> None:
        pass


def typing_sessions(
    events: DataFrame, gap_seconds: float = 1, delay: str = "10 minutes", buckets: int = BUCKETS
) -> DataFrame:
    """Finished typing bursts of an (id, conversation_id, user_id, ts, is_stop) stream.

    A burst ends at a stop event or after `gap_seconds` without an event. A burst is
    emitted once it is known to be over: at its stop, at the next event beyond the gap,
    or when the watermark passes the gap. `buckets` stays the same over a job's life.
    """
    ids = ["conversation_id", "user_id"]
    missing = F.col("conversation_id").isNull().cast("int") + F.col("user_id").isNull().cast("int") * 2
    keyed = (
        events.withColumn("event_time", F.col("ts").cast("timestamp_ltz"))
        .withWatermark("event_time", delay)
        .select(
            F.pmod(F.xxhash64(*ids), F.lit(buckets)).cast("int").alias("bucket"), "id", missing.alias("nulls"),
            # zeros rather than nulls, which would turn whole numbers into floats on the way
            *(F.coalesce(c, F.lit(0)).alias(c) for c in ids), F.coalesce("is_stop", F.lit(False)).alias("is_stop"),
            "event_time", epoch_micros(F.col("ts")).alias("at_us"),
        )
    )
    bursts = keyed.groupBy("bucket").transformWithStateInPandas(
        TypingSessions(int(gap_seconds * 1_000_000)), SESSION, "Append", "EventTime"
    )
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return bursts.select(
        *(F.when(F.col("nulls").bitwiseAND(bit) == 0, F.col(c)).alias(c) for bit, c in zip((1, 2), ids)),
        F.timestamp_add("MICROSECOND", F.col("start_us"), epoch).alias("started_at"),
        F.timestamp_add("MICROSECOND", F.col("last_us"), epoch).alias("last_event_at"),
        "n_events", "ended_by",
    )
