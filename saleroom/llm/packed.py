"""Hashes and places of one partition's rows, packed into one binary row per bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FAR = 255


def first_seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and place, start of each run of equal keys in it, size of each run)."""
    order = np.argsort(keys, kind="stable")
    runs = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0])) if len(keys) else np.zeros(0, np.int64)
    return order, runs, np.diff(np.append(runs, len(keys)))


def packed_places(places: np.ndarray) -> tuple[bytes, bytes]:
    """Rising places as one byte per step; steps of 255 and more go to a second array."""
    steps = np.diff(places, prepend=0)
    far = steps >= _FAR
    return np.where(far, _FAR, steps).astype(np.uint8).tobytes(), steps[far].astype(np.uint32).tobytes()


def unpacked_places(near: bytes, far: bytes) -> np.ndarray:
    steps = np.frombuffer(near, np.uint8).astype(np.int64)
    steps[steps == _FAR] = np.frombuffer(far, np.uint32)
    return np.cumsum(steps)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def dealt_out(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in rising order) of the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist() + [len(order)]
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(cuts, cuts[1:])]


SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("near", pa.binary()), ("far", pa.binary()), ("keys", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary())])
SENT = "bucket bigint, part bigint, near binary, far binary, keys binary, ids binary, runs binary"
_REPLY = pa.schema([("part", pa.int64()), ("near", pa.binary()), ("far", pa.binary())])
REPLY = "part bigint, near binary, far binary"


def replies_of(part: np.ndarray, places: np.ndarray) -> pa.Table:
    """Rows per partition of the (part, place) pairs."""
    rows = []
    order = np.lexsort([places, part])
    part, places = part[order], places[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
    for a, b in zip(cuts, cuts[1:]):
        rows.append((int(part[a]), *packed_places(places[a:b])))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REPLY.types)], schema=_REPLY) if rows else _REPLY.empty_table()


def sent_table(sent: list[tuple]) -> pa.Table:
    if not sent:
        return SENT_SCHEMA.empty_table()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent), SENT_SCHEMA.types)], schema=SENT_SCHEMA)


def received(rows: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, place, key) of every entry of a bucket."""
    part, places, keys = [], [], []
    for row in rows.select(["part", "near", "far", "keys"]).to_pylist():
        places.append(unpacked_places(row["near"], row["far"]))
        part.append(np.full(len(places[-1]), row["part"]))
        keys.append(np.frombuffer(row["keys"], kind))
    return np.concatenate(part), np.concatenate(places), np.concatenate(keys)


def answered(replies: pa.Table) -> np.ndarray:
    return np.concatenate(
        [np.zeros(0, np.int64)]
        + [unpacked_places(r["near"], r["far"]) for r in replies.select(["near", "far"]).to_pylist()]
    )
