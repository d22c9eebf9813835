"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has two terms, its own hash and the shape of its end, each in a fixed number of
buckets, and every bucket has a fixed sparse index vector. A bucket's context vector is the
sum of the index vectors next to its occurrences over the whole corpus. A document is the
mean of its terms' context vectors. A small network, trained in numpy on at most `TRAIN_ROWS`
labelled rows, gives the probability of good quality; its temperature is set on labelled rows
kept out of training.

The context table has BUCKETS + SHAPES rows of DIMENSIONS numbers whatever the input: it is
summed in Spark and may be broadcast. Only the text is an input.

Null and empty texts have the zero vector and get the score the network gives to it. Rows of
labels with a null id or quality are not learned from. Without labels of both kinds every
score is the share of label 1 among the labels (0.5 if there are none). Repeated documents are
scored each; repeated labels weigh more. Empty tables give an empty result. A very long text
is read whole. Other columns, whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.llm.tokens import Words, buffer_of, column, pieces, sampled, small_batches, words_of

BUCKETS = 1 << 13
SHAPES = 1 << 10
DIMENSIONS = 48
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 30
LEVEL = 0.3

_ROWS = BUCKETS + SHAPES


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(two places, two signs) of each bucket's sparse index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMENSIONS, (_ROWS, 2)), rng.choice(np.array([-1.0, 1.0]), (_ROWS, 2))


_PLACES, _SIGNS = _index_vectors()
# Byte classes of a word's end: letters by case, digits, other bytes as they are.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def terms(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the word, bucket of the shape of its last three bytes) of each word."""
    word = (found.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    size = found.ends - found.starts
    shape = np.zeros(len(word), np.int64)
    for k in range(1, 4):
        at = np.maximum(found.ends - k, 0)
        shape = shape * 257 + np.where(size >= k, _CLASS[found.data[at]] + 1, 0)
    mixed = (shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return word, BUCKETS + (mixed % np.uint64(SHAPES)).astype(np.int64)


def neighbour_sums(found: Words) -> np.ndarray:
    """What one piece of text adds to the context table, flat: words see the words and shapes next to them, shapes the shapes."""
    word, shape = terms(found)
    owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    together = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    left, right = together, together + 1
    cells, values = [], []
    for a, b in ((left, right), (right, left)):
        for target, other in ((word, word), (word, shape), (shape, shape)):
            for k in range(2):
                cells.append(target[a] * DIMENSIONS + _PLACES[other[b], k])
                values.append(_SIGNS[other[b], k])
    return np.bincount(np.concatenate(cells), np.concatenate(values), _ROWS * DIMENSIONS)


def context_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context vectors of all buckets over all documents, centred and of length one."""
    small_batches(docs.sparkSession)
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ROWS * DIMENSIONS)
        for batch in batches:
            for piece in pieces(batch):
                total += neighbour_sums(words_of(*buffer_of(column(piece, "text"))))
        table = total.reshape(_ROWS, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(table[used, k]) for k in range(DIMENSIONS))], ["bucket", *names]
        )

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect()  # at most _ROWS rows
    table = np.zeros((_ROWS, DIMENSIONS))
    for row in rows:
        table[row["bucket"]] = row[1:]
    for part in (table[:BUCKETS], table[BUCKETS:]):
        length = np.linalg.norm(part, axis=1, keepdims=True)
        np.divide(part, length, out=part, where=length > 0)
        used = length[:, 0] > 0
        if used.any():
            part[used] -= part[used].mean(axis=0)
    return table


def pooled(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The vector of each text: means of its words' and shapes' context vectors, and its length."""
    found = words_of(*buffer_of(texts))
    word, shape = terms(found)
    n = np.diff(found.first)
    owner = np.repeat(np.arange(len(n)), n)
    out = []
    for bucket, base, width in ((word, 0, BUCKETS), (shape, BUCKETS, SHAPES)):
        counts = np.bincount(owner * width + bucket - base, minlength=len(n) * width).reshape(len(n), width)
        out.append((counts @ table[base : base + width]) / np.maximum(n, 1)[:, None])
    return np.hstack([*out, np.log1p(n)[:, None]])


@dataclass
class Network:
    """Standardised input, one hidden layer, one logit; `flat` is the score of an untrained model."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    flat: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.weights
        return np.maximum((x - self.mean) / self.scale @ w + b, 0) @ u + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam over shuffled batches; every eighth row sets the temperature."""
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(1), np.ones(1), [], flat=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 8 == 7
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    size = x.shape[1]
    net = Network(mean, scale, [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    rows, step = np.flatnonzero(~kept), 0
    z = (x - mean) / scale
    for epoch in range(max(EPOCHS, -(-20_000 // len(rows)))):
        rng.shuffle(rows)
        for a in range(0, len(rows), 128):
            pick = rows[a : a + 128]
            w, b, u, c = net.weights
            hidden = np.maximum(z[pick] @ w + b, 0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ u + c, -500, 500))) - y[pick]) / len(pick)
            down = np.outer(wrong, u) * (hidden > 0)
            step += 1
            gradients = [z[pick].T @ down + 1e-4 * w, down.sum(axis=0), hidden.T @ wrong + 1e-4 * u, np.array([wrong.sum()])]
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if kept.any():
        logits = net.logits(x[kept])
        losses = {t: np.logaddexp(0, np.where(y[kept] > 0, -1, 1) * logits / t).mean() for t in np.geomspace(0.25, 8, 41)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def vectors(docs: DataFrame, table: np.ndarray, keep: str, text: str = "text") -> DataFrame:
    """(keep, vector) of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(keep, F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x = pooled(column(piece, "text"), shared.value)
                yield pa.RecordBatch.from_arrays([column(piece, keep), pa.array(list(x), pa.list_(pa.float64()))], [keep, "vector"])

    return rows.mapInArrow(run, f"{keep} {dict(rows.dtypes)[keep]}, vector array<double>")


def learned(
    docs: DataFrame, labels: DataFrame, table: np.ndarray, allowed: Column | None = None,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Network:
    """A network of a bounded sample of labelled rows: those with the smallest hashes of their id."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y"))
    sample = sampled(known, F.xxhash64("_id"), TRAIN_ROWS)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id")
    # an id may be repeated without end: one text of each, by the least text, keeps the sample bounded
    rows = rows.groupBy("_id", "_y").agg(F.min(F.struct(F.col("text").isNull().alias("no"), "text")).alias("r")).select("_id", "_y", "r.text")
    found = vectors(rows.select(F.struct("_id", "_y").alias("key"), "text"), table, "key").collect()
    found.sort(key=lambda r: (r["key"]["_id"], r["key"]["_y"], r["vector"]))
    # a fixed shuffle, so that the rows that set the temperature are no run of ids
    order = np.random.default_rng(5).permutation(len(found))
    x = np.array([found[i]["vector"] for i in order]) if found else np.zeros((0, 2 * DIMENSIONS + 1))
    return trained(x, np.array([found[i]["key"]["_y"] for i in order]))


def scored(docs: DataFrame, table: np.ndarray, net: Network, doc_id: str = "doc_id", text: str = "text", level: float = LEVEL) -> DataFrame:
    """doc_id, score (probability of good quality) and predicted of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for batch in batches:
            for piece in pieces(batch):
                score = net.scores(pooled(column(piece, "text"), table))
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array(score), pa.array((score >= level).astype(np.int32))], ["doc_id", "score", "predicted"]
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
