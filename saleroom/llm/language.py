"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and reduced to its words of letters. Every 2-, 3- and 4-byte run of a
word, its edges marked, is hashed into a fixed number of rows of an embedding table; the
text's vector is their mean and a linear softmax gives the languages. Table and softmax are
trained by stochastic gradient descent in numpy on at most `TRAIN_ROWS` labelled rows. A
temperature and the rejection level are set on labelled rows kept out of training.

As mean and softmax layer are both linear, prediction adds up one row of scores per subword.

A null text, or one without a letter, is `und` with score 0 and rejected. Rows without a
language are never learned from. Empty tables, and tables without any label, give `und` for
every row. Repeated rows are rows; a very long text is read whole, in pieces. Other columns,
whatever their names, are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.llm.tokens import buffer_of, column, is_held_out, mixed, pieces, sampled, segment_sums, small_batches

BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (2, 3, 4)
# Text scored at once: a byte of it takes some 200 bytes of arrays.
PIECE_BYTES = 1 << 18
# Labelled rows learned from: those with the smallest hashes of their id, whole.
TRAIN_ROWS = 2_000
BATCH = 32
# Passes over the sample, and for a small one at least so many steps.
EPOCHS = 6
STEPS = 400
RATE = 0.3
# Share of rightly named calibration rows that the rejection level may cost.
REJECT_RIGHT = 0.001
UNKNOWN = "und"

_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[[*range(97, 123)]] = True


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, index of each text's first): words of letters, other bytes are breaks."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    # symbols outside ASCII that are not letters are breaks too
    lowered = pc.replace_substring_regex(lowered, r"[^\p{L}\x00-\x7f]+", " ")
    # a break on both sides: a text of a single letter is a word as well
    space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    lowered = pc.binary_join_element_wise(space, lowered, space, nothing)
    data, at = buffer_of(pa.array(lowered) if not isinstance(lowered, pa.Array) else lowered)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = _LETTER[data]
    value = np.where(inside, data, 32).astype(np.uint64)
    edge = at[1:-1][at[1:-1] < len(data)]
    owner = np.zeros(len(data), np.int32)
    np.add.at(owner, edge, 1)
    owner = np.cumsum(owner) if len(edge) else owner
    found, place = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        key, whole = np.full(m, n, np.uint64), np.zeros(m, np.int8)
        for k in range(n):
            key = (key << np.uint64(8)) | value[k : k + m]
            whole += inside[k : k + m]
        # a run may begin or end with a break, not hold one inside
        ok = (whole >= n - 1) & (owner[:m] == owner[n - 1 :]) & (whole >= 1)
        if n > 2:
            for k in range(1, n - 1):
                ok &= inside[k : k + m]
        pick = np.flatnonzero(ok)
        found.append((mixed(key[pick]) % np.uint64(BUCKETS)).astype(np.int64))
        place.append(pick)
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    bucket, where = np.concatenate(found), np.concatenate(place)
    order = np.argsort(where, kind="stable")
    return bucket[order], np.searchsorted(where[order], at)


@dataclass
class LanguageModel:
    """scores: what one subword of each bucket adds to each language; texts below `least` are rejected."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, has it a letter?) of each text; no learned language: no columns."""
        bucket, first = subwords(texts)
        n = np.diff(first)
        sums = segment_sums(self.scores[bucket], first)
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        return softmax(z), n > 0

    def named(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, accepted?) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p, letters = self.probabilities(texts)
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score, letters & (score >= self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.size else z
    return e / e.sum(axis=1, keepdims=True) if z.size else e


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, share of the text's subwords) of one text."""
    bucket, n = np.unique(subwords(pa.array([text], pa.large_string()))[0], return_counts=True)
    return bucket, n / max(1, n.sum())


def trained(texts: list[str], labels: list[str], seed: int = 7) -> LanguageModel:
    """SGD over shuffled batches, each weight's step scaled by its past gradients (Adagrad).

    Every eighth row is kept for the temperature and the rejection level.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([languages.index(x) for x in labels])
    known = [shares(t) for t in texts]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    past_table, past_layer, past_bias = np.full(BUCKETS, 1e-8), np.full(layer.shape, 1e-8), np.full(bias.shape, 1e-8)
    checked = np.arange(len(y)) % 8 == 7
    rows = np.array([i for i in np.flatnonzero(~checked) if len(known[i][0])], int)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows)))) if len(rows) else 0
    for epoch in range(epochs):
        rng.shuffle(rows)
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(rows), BATCH):
            pick = rows[a : a + BATCH]
            sizes = np.array([len(known[i][0]) for i in pick])
            bucket, share = (np.concatenate([known[i][k] for i in pick]) for k in (0, 1))
            mean = segment_sums(table[bucket] * share[:, None], np.concatenate([[0], np.cumsum(sizes)]))
            wrong = softmax(mean @ layer + bias)
            wrong[np.arange(len(pick)), y[pick]] -= 1
            down = np.repeat(wrong @ layer.T, sizes, axis=0) * share[:, None]
            used, back = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(back, down[:, k], len(used)) for k in range(WIDTH)], axis=1)
            past_table[used] += (step**2).mean(axis=1)
            table[used] -= rate * step / np.sqrt(past_table[used])[:, None]
            for value, past, gradient in ((layer, past_layer, mean.T @ wrong), (bias, past_bias, wrong.sum(axis=0))):
                past += gradient**2
                value -= rate * gradient / np.sqrt(past)
    model = LanguageModel(languages, table @ layer, bias, 1.0, 0.0)
    held = [i for i in np.flatnonzero(checked) if len(known[i][0])]
    return calibrated(model, [texts[i] for i in held], y[held])


def calibrated(model: LanguageModel, texts: list[str], y: np.ndarray) -> LanguageModel:
    """The temperature of least log loss, then the level that costs REJECT_RIGHT of the right answers.

    The level is never above even chance between all languages plus a half of the rest.
    """
    if not len(texts):
        return model
    bucket, first = subwords(pa.array(texts, pa.large_string()))
    z = segment_sums(model.scores[bucket], first) / np.maximum(np.diff(first), 1)[:, None] + model.bias
    loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 5, 41)}
    model.temperature = float(min(loss, key=loss.get))
    p = softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    even = 1 / max(1, len(model.languages))
    if right.any():
        model.least = float(min(np.quantile(p[right].max(axis=1), REJECT_RIGHT), (1 + even) / 2))
    return model


def learned_from(
    docs: DataFrame, text: str = "text", lang: str = "lang", allowed: Column | None = None, doc_id: str = "doc_id"
) -> LanguageModel:
    """A model of a bounded sample of the rows with a language where `allowed` holds; ids only choose the sample."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    found = known.select(F.xxhash64(F.col(doc_id)).alias("_h"), F.col(text).alias("_t"), F.col(lang).alias("_l"))
    rows = sampled(found, F.col("_h"), TRAIN_ROWS).collect()
    return trained([r["_t"] for r in rows], [r["_l"] for r in rows])


def identified(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row; the model is a fixed number of rows wide."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most=PIECE_BYTES):
                name, score, ok = shared.value.named(column(piece, "text"))
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(ok)],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language the model names with enough confidence; one pass, no join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, PIECE_BYTES):
                _, _, ok = shared.value.named(column(piece, text))
                yield piece.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def training_rows(doc_id: str = "doc_id") -> Column:
    return ~is_held_out(F.col(doc_id))
