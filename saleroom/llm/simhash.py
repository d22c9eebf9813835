"""SimHash near-duplicates, linked through vantage-point trees.

A fingerprint has 64 bits; bit b is set if it is set in over half the XXH64 hashes of the
text's word shingles. Two fingerprints link at `radius` or fewer differing bits. Distances of
random fingerprints all lie near 32, where a ball of radius 4 straddles nearly every
boundary; so the bits are cut into three parts, and there is one tree per part: fingerprints
within 4 bits are within 1 bit in some part (4 // 3), and a ball of radius 1 straddles a
third of the boundaries. A tree's node holds a vantage point and a distance; a fingerprint's
home is one leaf, and it visits every leaf that the triangle inequality does not rule out.
Each leaf is a shard: homes are compared with visitors on all 64 bits.

Results of a shard are stars (each fingerprint to one of its group), so a group of copies
costs one row per fingerprint. Texts with the same fingerprint are one node throughout.

Null and empty texts have fingerprint zero and link like any other; a text with fewer words
than a shingle is one shingle. Repeated rows share their class. A null id is returned with
its class but is never a class's name unless all its ids are null. Empty tables give an empty
result. Other columns, whatever their names, are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.llm.components import components
from saleroom.llm.tokens import LOWER, column, pieces, sampled, small_batches

SHINGLE = 4
RADIUS = 4
SEED = 42
PARTS = 3
# Fingerprints at home in one shard, on average.
SHARD = 512
# Fingerprints that choose the vantage points and boundaries; they only shape the shards.
SAMPLE = 4096
# Beyond this depth shards are no longer cut in two: 3 * 2^16 nodes of 16 bytes are broadcast at most.
MOST_DEPTH = 16
_PIVOTS = 64
_CELLS = 1 << 21


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1)[n - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]


def fingerprints_of(texts: list[str | None], n: int = SHINGLE) -> np.ndarray:
    hashes = [shingle_hashes(t, n) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                fp = fingerprints_of(column(piece, "text").to_pylist(), n)
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


class Tree:
    """A vantage-point tree over the bits of `mask`, heap-ordered: node k has the children 2k+1, 2k+2."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = rng.integers(0, 1 << 63, inner, dtype=np.uint64) & self.mask
        self.border = np.full(inner, mask.bit_count() // 2, np.int64)
        held: list[np.ndarray] = [sample & self.mask] + [np.zeros(0, np.uint64)] * (2 * inner)
        for node in range(inner):
            points = held[node]
            if len(points) > 1:
                # of a few points, the one whose median cuts best
                best = -1
                for v in points[rng.integers(0, len(points), 4)]:
                    d = np.bitwise_count(points ^ v).astype(np.int64)
                    t = int(np.median(d))
                    left = int((d <= t).sum())
                    if left == len(points) and t > 0:
                        t -= 1
                        left = int((d <= t).sum())
                    even = min(left, len(points) - left)
                    if even > best:
                        best, self.vantage[node], self.border[node] = even, v, t
                near = np.bitwise_count(points ^ self.vantage[node]) <= self.border[node]
                held[2 * node + 1], held[2 * node + 2] = points[near], points[~near]

    def shards(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, leaf, at home?) of every leaf that each fingerprint lives in or visits."""
        at, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            d = np.bitwise_count((fps[at] & self.mask) ^ self.vantage[node]).astype(np.int64)
            t = self.border[node]
            left, right = d - radius <= t, d + radius > t
            inside = d <= t
            at, node, home = (
                np.concatenate([at[left], at[right]]),
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
                np.concatenate([(home & inside)[left], (home & ~inside)[right]]),
            )
        return at, node - ((1 << self.depth) - 1), home


def masks(parts: int = PARTS) -> list[int]:
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def grouped(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """A label (index of the group's first place) for each fingerprint; links need one end at home.

    A few pivots first: in a dense group they tie nearly all together, and members of the
    largest group then need comparing only with what lies outside it.
    """
    labels = np.arange(len(fps))

    def tie(row_places: np.ndarray, columns: np.ndarray) -> None:
        step = max(1, _CELLS // max(1, len(columns)))
        for a in range(0, len(row_places), step):
            rows = row_places[a : a + step]
            near = np.bitwise_count(fps[rows][:, None] ^ fps[columns][None, :]) <= radius
            for k in np.flatnonzero(near.any(axis=1)):
                found = np.unique(np.append(labels[columns[near[k]]], labels[rows[k]]))
                if len(found) > 1:
                    labels[np.isin(labels, found)] = found[0]

    rows, everything = np.flatnonzero(home), np.arange(len(fps))
    pivots = rows[:: max(1, len(rows) // _PIVOTS)]
    tie(pivots, everything)
    rest = np.setdiff1d(rows, pivots)
    largest = np.bincount(labels).argmax() if len(labels) else 0
    one = np.flatnonzero(labels == largest)[:1]
    tie(rest[labels[rest] != largest], everything)
    # the largest group may have joined one with a smaller label
    largest = labels[one[0]] if len(one) else largest
    members = rest[labels[rest] == largest]
    outside = np.flatnonzero(labels != largest)
    if len(members) and len(outside):
        tie(outside, members)
    return labels


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): stars that connect the distinct fingerprints `fp` within the radius, and nothing more."""
    n = fps.count()
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n) / shard))))
    sample = sampled(fps.select("fp"), F.xxhash64("fp"), SAMPLE).collect()
    points = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    small = radius // PARTS
    trees = [Tree(points, mask, depth, k) for k, mask in enumerate(masks())]
    shared = fps.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, "fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(shared.value):
                at, leaf, home = tree.shards(values, small)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k << MOST_DEPTH) + leaf), pa.array(values[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"]
                )

    return fps.mapInArrow(deal, "shard bigint, fp bigint, home boolean").groupBy("shard").applyInArrow(_stars(radius), "a bigint, b bigint")


def _stars(radius: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        values = rows.column("fp").to_numpy().astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, home = values[order], rows.column("home").to_numpy()[order]
        labels = grouped(values.view(np.uint64), home, radius)
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": values[tied], "b": values[labels[tied]]})

    return run


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable through links."""
    held = pinned(fingerprints(docs, doc_id, text, n))  # 16 bytes a document, read three times
    nodes = pinned(held.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return held.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each class, the rows with its smallest id stay.

    Rows with a null id stay if their class has no other id.
    """
    found = classes(docs, doc_id, text, n, radius)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["_gone"]), "left_anti")
