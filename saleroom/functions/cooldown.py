"""The greedy cooldown over sorted times, cut into parts anywhere.

A mail goes out at the first time of a key, then at each first time later than the last mail
plus the gap. How a part's last mail follows from the last mail before the part is a step
function: few steps where the part is longer than the gap, as all starts soon meet in one chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STATE = "_k {}, _part int, upto array<bigint>, last array<bigint>, first bigint"
ENTRY = "_k {}, _part int, _last bigint"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> pa.Table | None:
    held = [b.select(names) for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _runs(keys: pa.ChunkedArray) -> np.ndarray:
    """Start of each run of one key, and the end of all; nulls are one key."""
    value = keys.combine_chunks()
    before, after = value[:-1], value[1:]
    same = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
    return np.append(np.flatnonzero(np.append(True, ~same.to_numpy(zero_copy_only=False))), len(value))


def following(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time as a mail: the last mail of the chain that goes on from it."""
    nxt = np.searchsorted(times, times + gap, side="right")
    last = np.arange(len(times))
    end = np.where(nxt < len(times), nxt, last)
    while True:  # every turn doubles the mails that are passed
        further = end[end]
        if (further == end).all():
            return times[end]
        end = further


def state_of(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The states of the first and the last key of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _whole(batches, ["_k", "_t", "_part"])
        if rows is None:
            return
        cuts = _runs(rows.column("_k"))
        out = []
        for k in sorted({0, len(cuts) - 2}):
            times = rows.column("_t").slice(cuts[k], cuts[k + 1] - cuts[k]).to_numpy()
            last = following(times, gap)
            # an earlier mail lies before the first time, so only starts up to the gap beyond it matter
            n = min(len(times), int(np.searchsorted(times, times[0] + gap, side="right")) + 1)
            step = np.flatnonzero(np.append(np.diff(last[:n]) != 0, True))
            out.append((rows.column("_k")[cuts[k]].as_py(), rows.column("_part")[0].as_py(), times[step].tolist(), last[step].tolist(), int(last[0])))
        names = ["_k", "_part", "upto", "last", "first"]
        kinds = [rows.schema.field("_k").type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def chained(gap: int) -> Callable[[pa.Table], pa.Table]:
    """The last mail before each part of one key (null for its first part)."""

    def run(rows: pa.Table) -> pa.Table:
        found, last = [], None
        for state in sorted(rows.to_pylist(), key=lambda r: r["_part"]):
            found.append((state["_k"], state["_part"], last))
            if last is None:
                last = state["first"]
                continue
            at = int(np.searchsorted(np.array(state["upto"]), last + gap, side="right"))
            if at < len(state["last"]):
                last = state["last"][at]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found), (rows.schema.field("_k").type, pa.int32(), pa.int64()))], ["_k", "_part", "_last"]
        )

    return run


def counted(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, start, n): how many of a part's rows (n each time) fall into each chain link, given the last link before the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _whole(batches, ["_k", "_t", "_n", "_last"])
        if rows is None:
            return
        cuts = _runs(rows.column("_k"))
        times, sums = rows.column("_t").to_numpy(), np.append(0, np.cumsum(rows.column("_n").to_numpy()))
        before = rows.column("_last")
        entries, known = before.fill_null(0).to_numpy(), before.is_valid().to_numpy()
        at_row, start, n = [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at, first = a, int(entries[a]) if known[a] else int(times[a])
            while at < b:  # one turn per link
                end = a + int(np.searchsorted(times[a:b], first + gap, side="right"))
                if end > at:
                    at_row.append(a)
                    start.append(first)
                    n.append(int(sums[end] - sums[at]))
                at = end
                first = int(times[at]) if at < b else first
        keys = rows.column("_k").combine_chunks().take(pa.array(at_row, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(start, pa.int64()), pa.array(n, pa.int64())], ["_k", "_start", "_n"])

    return run


def mails(gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The times of a part that are mailed, given the last mail before the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _whole(batches, ["_k", "_t", "_last"])
        if rows is None:
            return
        cuts = _runs(rows.column("_k"))
        times = rows.column("_t").to_numpy()
        before = rows.column("_last")
        entries = before.fill_null(0).to_numpy()
        known = before.is_valid().to_numpy()
        sent = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = times[a:b]
            at = int(np.searchsorted(own, entries[a] + gap, side="right")) if known[a] else 0
            while at < len(own):  # one turn per mail
                sent.append(a + at)
                at = int(np.searchsorted(own, own[at] + gap, side="right"))
        kept = rows.select(["_k", "_t"]).take(pa.array(sent, pa.int64()))
        yield from kept.combine_chunks().to_batches()

    return run
