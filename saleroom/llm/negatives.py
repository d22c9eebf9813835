"""Hard negatives by inner product, searched in an R-tree packed by Sort-Tile-Recursive.

Rows are ordered by label and first coordinate and cut into slabs of about SLAB_ROWS rows, one
per Spark partition; inside a slab the recursion goes on, by label and then by the coordinate
that varies most, down to leaves of LEAF rows. Leaves are bounded by boxes (least and greatest
value per coordinate, least and greatest label, least id), and so are runs of FAN boxes. A box
bounds the inner product with an anchor coordinate by coordinate: each term lies between the
products with the box's two ends.

A search asks for the first k rows, by score and then by id, inside a window of scores, of the
anchor's label or of all others. It keeps a queue of boxes, best bound first, and drops boxes
whose interval misses the window, whose labels can't match, or whose bound is strictly below
the k-th row found (or equal to it, if all ids are larger). The slabs' boxes make up a
directory: an anchor first visits the most promising slab, and then those that may still hold
something better. Visits are grouped by slab and block of anchors, so a task holds one slab
and at most BLOCK anchors.

Rows with a null id, label, vector or component, or a component that isn't finite, take no
part. Rows with one id count once, with the smallest label and vector. A shorter vector counts
as filled up with zeros. Components become floor(scale * x), and scores are exact whole
numbers; those beyond a long are clipped. Equal scores go by the smaller id, equal positives
each have their negatives, and a positive below zero has none, as its window is empty. Anchors
without positives, and empty tables, give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.session import scratch_path

SCALE = 256
SLAB_ROWS = 8192
# The directory has a row of two ends per coordinate for each slab, and is broadcast: beyond this many slabs, slabs grow.
MOST_SLABS = 32_768
LEAF = 64
FAN = 16
BLOCK = 1024
_FAR = (1 << 63) - 1
_QUERY = "anchor_id bigint, label bigint, q binary, wins array<struct<id:bigint,lo:bigint,hi:bigint,kth:bigint,kid:bigint>>"
_FOUND = "anchor_id bigint, win bigint, score bigint, id bigint"


def whole_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v array<bigint>): the rows that take part, one per id."""
    held = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    fit = held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    whole = fit.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).alias("r"))
    return whole.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three widths, told by the first byte."""
    most = int(np.abs(values.astype(object)).max()) if values.size and (values == -_FAR - 1).any() else int(np.abs(values).max()) if values.size else 0
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return kind.encode() + values.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, chr(raw[0]), offset=1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where every sum fits, else in longs or whole numbers of any size."""
    size = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    bound = size(a) * size(b) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < _FAR:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_FAR, _FAR).astype(np.int64)


def filled(vectors: np.ndarray, dim: int) -> np.ndarray:
    return vectors if vectors.shape[1] >= dim else np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each row of q with anything in each box."""
    dim = max(q.shape[1], lo.shape[1])
    q, lo, hi = filled(q, dim), filled(lo, dim), filled(hi, dim)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    # added with care: two clipped halves stay within a long
    add = lambda x, y: np.where((x > 0) & (y > _FAR - np.maximum(x, 0)), _FAR, np.where((x < 0) & (y < -_FAR - np.minimum(x, 0)), -_FAR, x + y))
    return add(products(up, lo), products(down, hi)), add(products(up, hi), products(down, lo))


def tiled(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, first: bool = True) -> list[np.ndarray]:
    """Leaves of at most LEAF rows: by label, then each time by the coordinate that varies most. Ties go by id."""
    leaves = -(-len(rows) // LEAF)
    if leaves <= 1:
        return [rows] if len(rows) else []
    if first and labels[rows].min() < labels[rows].max():
        key = labels[rows]
    else:
        key = vectors[rows][:, int(vectors[rows].astype(np.float64).var(axis=0).argmax())] if vectors.shape[1] else ids[rows]
        first = False
    order = rows[np.lexsort([ids[rows], key])]
    slices = min(leaves, max(2, round(math.sqrt(leaves))))
    step = -(-leaves // slices) * LEAF
    return [leaf for x in range(0, len(order), step) for leaf in tiled(vectors, labels, ids, order[x : x + step], first)]


class Tree:
    """The R-tree of one slab: rows in leaf order, and boxes level by level, the leaves first."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.labels, self.ids = vectors, labels, ids
        starts = np.arange(0, len(ids), LEAF)
        lo, hi = np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts)
        sides = [np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts), np.minimum.reduceat(ids, starts)]
        boxes, self.children = [(lo, hi, *sides)], [np.zeros((0, 2), np.int64)]
        below, n = 0, len(starts)
        self.leaves = n
        while n > 1:
            starts = np.arange(0, n, FAN)
            lo, hi, label_lo, label_hi, least = boxes[-1]
            pairs = ((np.minimum, lo), (np.maximum, hi), (np.minimum, label_lo), (np.maximum, label_hi), (np.minimum, least))
            boxes.append(tuple(f.reduceat(x, starts) for f, x in pairs))
            self.children.append(np.stack([below + starts, below + np.minimum(starts + FAN, n)], axis=1))
            below, n = below + n, len(starts)
        self.lo, self.hi, self.label_lo, self.label_hi, self.least = (np.concatenate(x) for x in zip(*boxes))
        self.children = np.concatenate([np.zeros((self.leaves, 2), np.int64), *self.children[1:]])
        self.root = len(self.lo) - 1

    def search(self, q: np.ndarray, label: int, anchor: int, same: bool, wins: list[dict], k: int, least: np.ndarray, most: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each window the first k rows (score, id); least, most: the boxes' intervals with q."""
        fits = (self.label_lo <= label) & (self.label_hi >= label) if same else ~((self.label_lo == label) & (self.label_hi == label))
        scores: dict[int, tuple[list[int], list[int]]] = {}
        return [self._window(q, label, anchor, same, w, k, fits, least, most, scores) for w in wins]

    def _leaf(self, leaf: int, q: np.ndarray, label: int, anchor: int, same: bool) -> tuple[list[int], list[int]]:
        rows = slice(leaf * LEAF, (leaf + 1) * LEAF)
        fit = ((self.labels[rows] == label) == same) & (self.ids[rows] != anchor)
        return products(q[None, :], self.vectors[rows][fit])[0].tolist(), self.ids[rows][fit].tolist()

    def _window(self, q: np.ndarray, label: int, anchor: int, same: bool, win: dict, k: int, fits: np.ndarray, least: np.ndarray, most: np.ndarray, scores: dict) -> list[tuple[int, int]]:
        lo, hi = win["lo"], win["hi"]
        found: list[tuple[int, int]] = []  # a heap with the worst of the k best on top, as (score, -id)
        bar = (win["kth"], -win["kid"]) if win["kth"] is not None else None

        def worst() -> tuple[int, int] | None:
            return max(found[0], bar) if len(found) == k and bar else found[0] if len(found) == k else bar

        def push(node: int) -> None:
            top = min(int(most[node]), hi)
            edge = worst()
            if fits[node] and least[node] <= hi and most[node] >= lo and (edge is None or (top, -int(self.least[node])) >= edge):
                heapq.heappush(queue, (-top, int(self.least[node]), node))

        queue: list[tuple[int, int, int]] = []
        push(self.root)
        while queue:
            top, first, node = heapq.heappop(queue)
            edge = worst()
            if edge is not None and -top < edge[0]:
                break  # strictly below the k-th, and so is all that is left
            if edge is not None and (-top, -first) < edge:
                continue
            if node >= self.leaves:
                for child in range(*self.children[node]):
                    push(child)
                continue
            if node not in scores:
                scores[node] = self._leaf(node, q, label, anchor, same)
            for score, row in zip(*scores[node]):
                if lo <= score <= hi:
                    edge = worst()
                    if edge is None or (score, -row) > edge:
                        (heapq.heappushpop if len(found) == k else heapq.heappush)(found, (score, -row))
        return [(s, -r) for s, r in sorted(found, reverse=True)]


def slabs_of(vectors: DataFrame, n: int, slab_rows: int) -> DataFrame:
    """One row per slab, written to the shared folder: its rows in leaf order, and its box."""
    schema = "slab bigint, dim bigint, vectors binary, labels binary, ids binary, lo binary, hi binary, label_lo bigint, label_hi bigint, least bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        lists = table["v"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        dim, starts = int(sizes.max()), np.cumsum(sizes) - sizes
        values = np.zeros((len(sizes), dim), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        values[row, np.arange(len(row)) - starts[row]] = lists.flatten().to_numpy()
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        order = np.concatenate(tiled(values, labels, ids, np.arange(len(ids))))
        values, labels, ids = values[order], labels[order], ids[order]
        cols = [TaskContext.get().partitionId(), dim, packed(values), packed(labels), packed(ids), packed(values.min(axis=0)), packed(values.max(axis=0)), labels.min(), labels.max(), ids.min()]
        names = [x.split()[0] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], names)

    parts = max(1, math.ceil(n / max(slab_rows, math.ceil(n / MOST_SLABS))))
    path = scratch_path(vectors.sparkSession, "slabs")
    ranged = vectors.repartitionByRange(parts, "label", F.get("v", F.lit(0)), "id").select("id", "label", "v")
    ranged.mapInArrow(pack, schema).write.parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


class Directory:
    """The slabs' boxes. At most MOST_SLABS rows (times the skew of the range cuts), whatever the input."""

    def __init__(self, slabs: DataFrame) -> None:
        rows = slabs.select("slab", "dim", "lo", "hi", "label_lo", "label_hi", "least").collect()
        dim = max([r["dim"] for r in rows], default=0)
        side = lambda c: np.array([np.pad(x := unpacked(r[c]), (0, dim - len(x))) for r in rows], np.int64).reshape(len(rows), dim)
        self.lo, self.hi = side("lo"), side("hi")  # coordinates that a slab doesn't have are zeros
        self.slab, self.label_lo, self.label_hi, self.least = (np.array([r[c] for r in rows], np.int64) for c in ("slab", "label_lo", "label_hi", "least"))

    def visited(self, q: np.ndarray, label: int, same: bool, wins: list[dict], least: np.ndarray, most: np.ndarray, first: bool) -> np.ndarray:
        """Slabs that the anchor visits at first (the most promising one), or after that (all others that may matter)."""
        fits = (self.label_lo <= label) & (self.label_hi >= label) if same else ~((self.label_lo == label) & (self.label_hi == label))
        wanted = np.zeros(len(self.slab), bool)
        top = np.full(len(self.slab), -_FAR)
        for w in wins:
            this = fits & (least <= w["hi"]) & (most >= w["lo"])
            height = np.minimum(most, w["hi"])
            top = np.where(this, np.maximum(top, height), top)
            if w["kth"] is not None and not first:
                this &= (height > w["kth"]) | ((height == w["kth"]) & (self.least <= w["kid"]))
            wanted |= this
        at = np.flatnonzero(wanted)
        return at[np.lexsort([self.least[at], -top[at]])[:1]] if first and len(at) else at


def _visits(queries: DataFrame, shared: object, same: bool, first: bool, blocks: int) -> DataFrame:
    """A row per anchor and slab that it visits. After the first visit, the slab of that one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: Directory = shared.value  # type: ignore[attr-defined]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.to_pylist()
                slab, row = [], []
                dim = max(len(unpacked(r["q"])) for r in rows)
                q = np.stack([np.pad(x := unpacked(r["q"]), (0, dim - len(x))) for r in rows])
                least, most = intervals(q, directory.lo, directory.hi)
                for k, r in enumerate(rows):
                    at = directory.slab[directory.visited(q[k], r["label"], same, r["wins"], least[k], most[k], first)]
                    at = at[at != r["seen"]] if r["seen"] is not None else at
                    slab.append(at)
                    row.append(np.full(len(at), k))
                taken = part.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slab)), *(taken.column(c) for c in ("anchor_id", "label", "q", "wins"))], ["slab", "anchor_id", "label", "q", "wins"])

    return queries.mapInArrow(run, f"slab bigint, {_QUERY}").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)))


def _searched(same: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(visits: pa.Table, slabs: pa.Table) -> pa.Table:
        slab = slabs.slice(0, 1).to_pylist()[0]
        ids = unpacked(slab["ids"])
        tree = Tree(unpacked(slab["vectors"]).reshape(len(ids), slab["dim"]), unpacked(slab["labels"]), ids)
        out: list[tuple[int, int, int, int]] = []
        for start in range(0, visits.num_rows, 256):
            rows = visits.slice(start, 256).to_pylist()
            dim = max(slab["dim"], *(len(unpacked(r["q"])) for r in rows))
            q = np.stack([np.pad(x := unpacked(r["q"]), (0, dim - len(x))) for r in rows])
            least, most = intervals(q, tree.lo, tree.hi)
            for i, r in enumerate(rows):
                found = tree.search(q[i, : slab["dim"]], r["label"], r["anchor_id"], same, r["wins"], k, least[i], most[i])
                out += [(r["anchor_id"], w["id"], score, row) for w, best in zip(r["wins"], found) for score, row in best]
        cols = zip(*out) if out else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "win", "score", "id"), cols)})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, slabs: DataFrame, directory: object, same: bool, k: int, blocks: int) -> DataFrame:
    """(anchor_id, win, score, id, rank) of the first k rows in every window of every query: one slab first, then the rest."""

    def visit(asked: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        visits = _visits(asked, directory, same, first, blocks)
        pairs = visits.select(F.col("slab").alias("at"), F.col("block").alias("of")).distinct()
        met = slabs.join(pairs, F.col("slab") == F.col("at"))
        found = visits.groupBy("slab", "block").cogroup(met.groupBy("at", "of")).applyInArrow(_searched(same, k), _FOUND)
        return visits, found

    visits, found = visit(queries.withColumn("seen", F.lit(None).cast("bigint")), True)
    held = pinned(found)
    full = held.groupBy("anchor_id", "win").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("id")).alias("less"))).alias("last"))
    bars = full.where(F.col("n") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("win", F.lit(-1)), F.col("last")))).alias("bars"))
    seen = visits.select("anchor_id", F.col("slab").alias("seen"))

    def told(w: Column) -> Column:
        bar = F.element_at("bars", F.coalesce(w["id"], F.lit(-1)))
        return F.struct(w["id"].alias("id"), w["lo"].alias("lo"), w["hi"].alias("hi"), bar["score"].alias("kth"), (-bar["less"]).alias("kid"))

    again = queries.join(seen, "anchor_id").join(bars, "anchor_id", "left").withColumn("wins", F.transform("wins", told))
    _, more = visit(again.select(*queries.columns, "seen"), False)
    return _ranked(held.unionByName(more), k)


def _asked(anchors: DataFrame, wins: str) -> DataFrame:
    return anchors.select("anchor_id", "label", "q", F.expr(wins).alias("wins"))


def hard_negatives(
    rows: DataFrame,
    every: int,
    positives: int = 5,
    negatives: int = 5,
    least_share: tuple[int, int] = (4, 5),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    slab_rows: int = SLAB_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: rows whose id is divisible by `every`. Positives: the first rows of the anchor's
    label. Negatives of a positive: the first rows of other labels with a score from
    least_share of the positive's to the positive's own.
    """
    vectors = pinned(whole_vectors(rows, vec_id, vector, label, scale))
    n, n_anchors = vectors.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    slabs = slabs_of(vectors, n, slab_rows)
    directory = rows.sparkSession.sparkContext.broadcast(Directory(slabs))
    blocks = max(1, math.ceil(n_anchors / BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [packed(np.array(v, np.int64)) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(q, pa.binary())], ["anchor_id", "label", "q"])

    anchors = pinned(vectors.where(F.col("id") % every == 0).mapInArrow(pack, "anchor_id bigint, label bigint, q binary"))
    everything = f"array(named_struct('id', cast(null as bigint), 'lo', {-_FAR}L, 'hi', {_FAR}L, 'kth', cast(null as bigint), 'kid', cast(null as bigint)))"
    alike = pinned(
        nearest(_asked(anchors, everything), slabs, directory, True, positives, blocks)
        .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    # the least whole score of the window, without leaving the whole numbers
    low = F.col("positive_score") - F.expr(f"positive_score * {least_share[1] - least_share[0]} div {least_share[1]}")
    window = F.struct(
        F.col("positive_id").alias("id"), low.cast("bigint").alias("lo"), F.col("positive_score").alias("hi"),
        F.lit(None).cast("bigint").alias("kth"), F.lit(None).cast("bigint").alias("kid"),
    )
    windows = alike.where(F.col("positive_score") >= 0).groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("wins"))
    asked = pinned(anchors.join(windows, "anchor_id").select("anchor_id", "label", "q", "wins"))
    found = nearest(asked, slabs, directory, False, negatives, blocks)
    return found.withColumnRenamed("win", "positive_id").join(alike, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
