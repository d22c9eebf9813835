"""Words, lines and hashes of many texts at once, as numpy arrays over one byte buffer.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. A null text has
no words. Hashes are 64-bit polynomial hashes over random byte values, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How much text is turned into arrays at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20

WORD_BREAK = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BYTES = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = powers(_STEP, 1)
    down = powers(_BACK, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(_STEP, size), powers(_BACK, size)
        return cls.up, cls.down


class SpanHash:
    """Hashes of byte spans of one buffer, each in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


@dataclass
class Words:
    """starts/ends: byte span of each word in data; first: index of each text's first word, and the total."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return SpanHash(self.data).of(self.starts, self.ends)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edge = at[(at > 0) & (at < len(data))]  # a text's end always ends a word
    begin[edge] = inside[edge + 1]
    end[edge - 1] = inside[edge]
    starts = np.flatnonzero(begin)
    return Words(data, at, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at))


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes of text, or one row if that is longer."""
    whole = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    for part in whole.to_batches():
        if not part.num_rows:
            continue
        _, at = buffer_of(part.column(part.schema.get_field_index(text)))
        row = 0
        while row < part.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield part.slice(row, stop - row)
            row = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes; the last n - 1 places hold nothing useful."""
    out = h.copy()
    for k in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out[: len(h) - k] += h[k:]
    return mixed(out)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows values[first[i]:first[i+1]]; empty segments give zero."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in one Arrow batch: documents are long, and a worker holds whole batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words(text: str | Column) -> Column:
    """The words of a text as an array column; empty for null."""
    parts = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), WORD_BREAK)
    return F.filter(parts, lambda w: w != "")


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0: never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def whole_id(docs: DataFrame, doc_id: str) -> Column:
    """The id column as longs; ids of another kind would all become null, and are refused."""
    kind = dict(docs.dtypes)[doc_id]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} must hold whole numbers, not {kind}")
    return F.col(doc_id).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(rows: DataFrame, by: Column, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest values of the hash `by`, in its order.

    The rows are counted first and cut to about 1.5 times that many by the hash alone, so
    that what the tasks send to the driver does not grow with their number.
    """
    place = F.shiftrightunsigned(by, 1)
    share = min(1.0, 1.5 * most / max(1, rows.count()))
    cut = rows.withColumn("_place", place).where(F.col("_place") <= F.lit(min(2**63 - 1, int(share * 2**63))))
    return cut.orderBy("_place", *rows.columns).limit(most).drop("_place")
