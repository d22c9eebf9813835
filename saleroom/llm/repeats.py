"""Removal of repeated passages through fixed-block anchors.

A passage is a window of `window` consecutive words; a window whose word sequence also starts
earlier (smaller id, or earlier in the same document) is a repeat, and every word it covers
goes. Any window of 20 words holds a whole block of 10 words at a place divisible by 10. So:

1. Anchors. Documents are dealt into partitions by a hash of their id. Each partition sends
   the hash of every rolling 10-word window, with a mark if it is one of the non-overlapping
   reference blocks. Windows that occur twice or more with at least one reference block among
   them are hits; the hits go back to the partitions they came from.
2. Extension. Windows of 20 words that hold a hit are the only ones that can repeat. They are
   compared on a hash of the whole window, and all but the first occurrence go back as
   repeats. Unbroken runs of them are the maximal exact repeats.
3. Each partition removes the words covered and joins the rest.

Within a partition each hash is sent once, so a passage that occurs everywhere costs one
entry per partition. No pairs are made. Hashes and places travel as packed arrays, five bytes
for a rolling window; a first-stage collision only adds a candidate. The second stage compares
64 bits and a bucket taken from other bits.

Ids are ordered as numbers, null ids first. Rows with one id are ordered by text. Null and
empty texts have no words. Documents shorter than a window lose nothing. Empty tables give an
empty result. A very long text belongs to one partition whole. Other columns, whatever their
names, are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.llm.packed import (
    REPLY, SENT, SENT_SCHEMA, answered, bucket_of, dealt_out, first_seen, packed_places, received, replies_of, sent_table,
)
from saleroom.llm.tokens import CHUNK_BYTES, buffer_of, pieces, rolling, whole_id, words_of

WINDOW = 20
# Text of one partition, on average, and entries of one bucket.
PART_CHARS = 8_000_000
BUCKET_WORDS = 2_500_000


@dataclass
class Part:
    """The documents of one partition in order, and the hashes of their words."""

    ids: np.ndarray
    texts: pa.Array
    first: np.ndarray  # first word of each document, and the total
    hashes: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Part:
        rows = rows.combine_chunks()
        order = pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        rows = rows.take(order).combine_chunks()
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for piece in pieces(rows.select(["text"]), most=CHUNK_BYTES):
            found = words_of(*buffer_of(piece.column(0)))
            hashes.append(found.hashes())
            sizes.append(np.diff(found.first))
        ids = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        return Part(ids, texts, np.cumsum(np.concatenate(sizes)), np.concatenate(hashes))

    def inside(self, n: int) -> np.ndarray:
        """At which words a window of n words starts that ends in the same document."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hashes)) + n <= ends

    def places(self) -> np.ndarray:
        """Each word's place in its document."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))


def _blocks(part: Part, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the rolling block from each word, words where one starts), in documents that hold a window."""
    block = window // 2
    long_enough = np.repeat(np.diff(part.first) >= window, np.diff(part.first))
    return rolling(part.hashes, block), np.flatnonzero(part.inside(block) & long_enough)


def _send_blocks(window: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("part")[0].as_py()
        part = Part.of(rows)
        hashes, at = _blocks(part, window)
        order, runs, _ = first_seen(hashes[at])
        anchored = part.places()[at] % (window // 2) == 0
        anchored = np.add.reduceat(anchored[order], runs) > 0 if len(runs) else np.zeros(0, bool)
        one = order[runs]  # the first of each, in the order of the hash
        back = np.argsort(one)
        one, anchored = at[one[back]], anchored[back]
        keys = (hashes[one] & np.uint64(0xFFFFFFFE)).astype(np.uint32) | anchored.astype(np.uint32)
        sent = [
            (b, number, *packed_places(one[pick]), keys[pick].tobytes(), None, None)
            for b, pick in dealt_out(bucket_of(hashes[one], buckets))
        ]
        return sent_table(sent)

    return run


def _hits(rows: pa.Table) -> pa.Table:
    part, places, keys = received(rows, np.uint32)
    order, runs, sizes = first_seen(keys >> np.uint32(1))
    anchored = np.add.reduceat((keys & np.uint32(1))[order].astype(np.int64), runs) > 0
    hit = order[np.repeat((sizes > 1) & anchored, sizes)]
    return replies_of(part[hit], places[hit])


def _windows(part: Part, window: int) -> np.ndarray:
    """A hash of the window from each word: its two halves' hashes, joined."""
    half = rolling(part.hashes, window // 2)
    both = rolling(part.hashes, window - window // 2)
    out = half * np.uint64(0xA0761D6478BD642F)
    n = max(0, len(out) - window // 2)
    out[:n] ^= both[window // 2 :] * np.uint64(0xE7037ED1A0B428DB)
    return out ^ (out >> np.uint64(32))


def _send_windows(window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    block = window // 2

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SENT_SCHEMA.empty_table()
        number = rows.column("part")[0].as_py()
        part = Part.of(rows)
        hashes, at = _blocks(part, window)
        hit = np.zeros(len(part.hashes) + 1, np.int64)
        order, _, sizes = first_seen(hashes[at])
        hit[at[order[np.repeat(sizes > 1, sizes)]]] = 1  # known here already
        hit[answered(replies)] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        starts = np.flatnonzero(part.inside(window))
        starts = starts[before[starts + window - block + 1] > before[starts]]
        keys = _windows(part, window)[starts]
        order, runs, _ = first_seen(keys)
        one = np.sort(order[runs])
        starts, keys = starts[one], keys[one]
        owner = np.searchsorted(part.first, starts, "right") - 1
        sent = []
        for b, pick in dealt_out(bucket_of(keys * np.uint64(0x9E3779B97F4A7C15), buckets)):
            runs = np.flatnonzero(np.diff(owner[pick], prepend=-1))
            counts = np.diff(np.append(runs, len(pick)))
            ids = part.ids[owner[pick][runs]]
            sent.append((b, number, *packed_places(starts[pick]), keys[pick].tobytes(), ids.astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes()))
        return sent_table(sent)

    return run


def _later(rows: pa.Table) -> pa.Table:
    part, places, keys = received(rows, np.uint64)
    ids = np.concatenate(
        [np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["runs"], np.uint32)) for r in rows.select(["ids", "runs"]).to_pylist()]
    )
    order = np.lexsort([places, ids, keys])
    again = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    return replies_of(part[order[again]], places[order[again]])


def _covered(part: Part, replies: pa.Table, window: int) -> np.ndarray:
    starts = np.flatnonzero(part.inside(window))
    order, runs, _ = first_seen(_windows(part, window)[starts])
    again = np.ones(len(starts), bool)
    again[runs] = False
    edges = np.zeros(len(part.hashes) + 1, np.int64)
    for found in (starts[order[again]], answered(replies)):
        np.add.at(edges, found, 1)
        np.add.at(edges, found + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _remove(window: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], rows.schema.field("doc_id").type), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        part = Part.of(rows)
        gone = _covered(part, replies, window)
        kept = []
        for k, text in enumerate(part.texts):
            a, b = part.first[k], part.first[k + 1]
            found = (text.as_py() or "").encode().split()
            rest = b" ".join(compress(found, (~gone[a:b]).tolist()) if gone[a:b].any() else found)
            kept.append(rest.decode() if with_text else hashlib.sha256(rest).hexdigest())
        sums = np.concatenate([[0], np.cumsum(gone)])
        low = np.iinfo(np.int64).min
        return pa.table({
            "doc_id": pa.array([None if i == low else i for i in part.ids.tolist()], pa.int64()),
            "n_words": pa.array(np.diff(part.first)),
            "n_removed": pa.array(sums[part.first[1:]] - sums[part.first[:-1]]),
            "kept": pa.array(kept, pa.string()),
        })

    return run


def without_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """doc_id (a whole number; anything else is an error), n_words, n_removed and kept: the words left, joined by one space.

    with_text=False gives the SHA-256 of kept instead. The number of partitions and buckets
    follows the amount of text, so their size does not.
    """
    rows = docs.select(whole_id(docs, doc_id).alias("doc_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, chars // PART_CHARS)
    buckets = max(1, chars // 6 // BUCKET_WORDS)
    # the same exchange of the texts serves all three stages
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    hits = dealt.groupBy("part").applyInArrow(_send_blocks(window, buckets), SENT).groupBy("bucket").applyInArrow(_hits, REPLY)
    later = (
        dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_send_windows(window, buckets), SENT)
        .groupBy("bucket").applyInArrow(_later, REPLY)
    )
    return dealt.groupBy("part").cogroup(later.groupBy("part")).applyInArrow(
        _remove(window, with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )
