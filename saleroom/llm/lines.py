"""Line dedup with a log-template tree.

A line is parsed to a leaf of fixed depth: its number of words and its first `DEPTH` words,
words with a digit standing for a variable field (unless they are most of the line). A field
without a digit may stand among the first words; so a line whose leaf is rare goes to a second
branch, by its number of words and its last `DEPTH` words. Leaves that occur in `least` or more
different documents are looked into. There a place's word is fixed if it stands in that place
in `least` or more documents of the leaf, and variable otherwise: what other lines the leaf
holds makes no difference. A template is

* a line as it is (fields aside), or else
* the fixed words of a line with their places, if they are most of it and `BEYOND` of them
  stand outside the leaf (in a line too short for that, all words but one, if as many stand
  outside the leaf as in it), or else
* the same less one of them: a field whose values are frequent in the leaf on their own.

Lines of a template that occurs in `least` or more different documents are dropped, except in
the template's first document (smallest id), so that nothing is lost where it is unique.
Documents with the same text count as one: a copied document is no template.

The work goes by partitions of whole documents, in three rounds of one question: which keys
(leaves; words in places, and lines; templates) occur in `least` or more documents? A
partition reports at most `least` documents of a key, which is all that the decision needs, and
keys are dealt out by their hash. So neither a line in a third of all documents nor a leaf
with a third of all lines meets in one task. The first round reads whole texts; the others read
the looked-into lines alone, which are taken out once, and the last step cuts by their spans.

A null text stays null and has no lines. Lines without a word are kept. A document whose lines
all go has an empty text. Rows with a null id come first. Repeated rows are edited alike.
Empty tables give an empty result. A very long text belongs to one partition whole. All other
columns are carried. Ids must be whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from saleroom.llm.packed import (
    SENT, bucket_of, dealt_out, first_seen, packed_places, received, sent_table, unpacked_places,
)
from saleroom.llm.tokens import SpanHash, buffer_of, mixed, pieces, powers, whole_id, words_of

DEPTH = 3
LEAST_DOCS = 10
# Share of a template's places that aren't variable.
FIXED = 0.6
# Fixed words that a template with variable places must have beside those that make its leaf: a leaf alone is no template.
BEYOND = 4
PART_CHARS = 4_000_000
BUCKET_LINES = 200_000
_FIELD = np.uint64(0x5BF03635)
_LOW = np.iinfo(np.int64).min


@dataclass
class Lines:
    """The lines with a word of one partition: span in its text, document, leaf, key; words as masked hashes."""

    ids: np.ndarray
    digests: np.ndarray
    texts: list[bytes | None]
    owner: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    words: np.ndarray
    leaf: np.ndarray
    tail: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Lines:
        """The lines of rows that are whole texts, or looked-into lines with the digests of their texts."""
        rows = rows.combine_chunks()
        found = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)]
        texts: list[bytes | None] = []
        for piece in pieces(rows.select(["text"])):
            at_text = len(texts)
            texts += [None if t is None else t.encode() for t in piece.column(0).to_pylist()]
            data, at = buffer_of(piece.column(0))
            w = words_of(data, at)
            h = w.hashes()
            digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
            field = digits[w.ends] > digits[w.starts]
            # where lines begin: after each line feed and at each text's start
            begins = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, at[:-1]]))
            begins = begins[begins < len(data)]
            of_word = np.searchsorted(begins, w.starts, "right") - 1
            used, first, size = np.unique(of_word, return_index=True, return_counts=True)
            ends = np.append(begins[1:], len(data))[used] if len(used) else np.zeros(0, np.int64)
            begin = begins[used] if len(used) else np.zeros(0, np.int64)
            owner = np.searchsorted(at, begin, "right") - 1
            if len(used):  # in a line of mostly fields, what stands in them is all there is
                fields = np.add.reduceat(field.astype(np.int64), first)
                h[field & np.repeat(fields <= (1 - FIXED) * size, size)] = _FIELD
            leaf, tail = size.astype(np.uint64), ~size.astype(np.uint64)
            for k in range(DEPTH if len(used) else 0):
                word = np.where(size > k, h[np.minimum(first + k, len(h) - 1)], np.uint64(0))
                leaf = mixed(leaf * np.uint64(31) + word)
                word = np.where(size > k, h[np.maximum(first + size - 1 - k, 0)], np.uint64(0))
                tail = mixed(tail * np.uint64(31) + word)
            base = sum(len(x) for x in found[4])
            for k, x in enumerate((owner + at_text, begin - at[owner], ends - at[owner], first + base, h, leaf, tail)):
                found[k].append(x)
        owner, begin, end, first, words, leaf, tail = (np.concatenate(x) for x in found)
        ids = rows.column("doc_id").fill_null(_LOW).to_numpy()
        digests = rows.column("digest").to_numpy() if "digest" in rows.column_names else np.array(
            [int.from_bytes(hashlib.blake2b(t or b"", digest_size=8).digest(), "big", signed=True) for t in texts], np.int64
        )
        return Lines(ids, digests, texts, owner, begin, end, np.append(first, len(words)), words, leaf, tail)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Both leaves of every line, with the line's document."""
        return np.concatenate([self.leaf, self.tail]), np.tile(self.owner, 2)

    def of_words(self) -> tuple[np.ndarray, np.ndarray]:
        """The line of every word, and its place there."""
        size = np.diff(self.first)
        return np.repeat(np.arange(len(size)), size), np.arange(len(self.words)) - np.repeat(self.first[:-1], size)

    def keys(self) -> np.ndarray:
        """A hash of each line's words in their order."""
        _, place = self.of_words()
        up = powers(np.uint64(0xD6E8FEB86659FD93), int(np.diff(self.first).max(initial=1)))
        return mixed(np.add.reduceat(self.words * up[place], self.first[:-1])) if len(self.owner) else np.zeros(0, np.uint64)


def settled(rows: pa.Table) -> pa.Table:
    """A partition's rows by id and text: shuffles hand them over in any order, and keys are told by their places."""
    rows = rows.combine_chunks()
    ids = rows.column("doc_id").fill_null(_LOW).to_numpy()
    digests = np.array([hashlib.blake2b((t or "").encode(), digest_size=16).digest() + bytes([t is None]) for t in rows.column("text").to_pylist()], "S17")
    return rows.take(pa.array(np.lexsort([digests, ids]))).combine_chunks()


def _some_of_each(group: np.ndarray, digest: np.ndarray, most: int) -> np.ndarray:
    """Places of at most `most` different digests of each group, the smallest ones."""
    order = np.lexsort([digest, group])
    g, d = group[order], digest[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    order, g = order[new], g[new]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return np.sort(order[rank < most])


COMMON = "part bigint, round int, near binary, far binary, firsts binary"
_COMMON = pa.schema([("part", pa.int64()), ("round", pa.int32()), ("near", pa.binary()), ("far", pa.binary()), ("firsts", pa.binary())])


def _answers(keys: np.ndarray, replies: pa.Table | None, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """(is each key common?, the first document of those that are): the replies name one place of each common key."""
    mine = [r for r in replies.to_pylist() if r["round"] == round_] if replies is not None else []
    at = np.concatenate([np.zeros(0, np.int64)] + [unpacked_places(r["near"], r["far"]) for r in mine])
    first = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r["firsts"], np.int64) for r in mine])
    found, once = np.unique(keys[at], return_index=True)
    if not len(found):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    slot = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    hit = found[slot] == keys
    return hit, np.where(hit, first[once][slot], 0)


OPENED = "part bigint, row bigint, doc_id bigint, digest bigint, text string, lead binary, begins binary"
_OPENED = pa.schema([
    ("part", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()),
    ("text", pa.string()), ("lead", pa.binary()), ("begins", pa.binary()),
])


def _open(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """The looked-into lines of each text that has some, one after another, with the text's place in the partition.

    A line is looked into by its leading leaf if that is common (`lead`), else by the trailing one.
    """
    if not rows.num_rows:
        return _OPENED.empty_table()
    own = Lines.of(settled(rows))
    common, _ = _answers(own.leaves()[0], replies, 0)
    lead, trail = np.split(common, 2)
    at = np.flatnonzero(lead | trail)
    owner, begin, end = own.owner[at], own.begin[at], own.end[at]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(at)]
    spans = list(zip(cuts, cuts[1:]))
    texts = owner[cuts[:-1]]
    joined = [b"".join(own.texts[owner[a]][x:y] for x, y in zip(begin[a:b], end[a:b])).decode() for a, b in spans]
    columns = (
        np.full(len(spans), rows.column("part")[0].as_py()), texts, own.ids[texts], own.digests[texts], joined,
        [lead[at[a:b]].tobytes() for a, b in spans], [begin[a:b].tobytes() for a, b in spans],
    )
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _OPENED.types)], schema=_OPENED)


class Known:
    """What a partition's looked-into lines asked about and learned in the rounds after the first."""

    def __init__(self, opened: pa.Table, replies: pa.Table | None, upto: int) -> None:
        opened = opened.sort_by("row")
        self.own = Lines.of(opened)
        self.rows = opened.column("row").to_numpy()
        lead, self.begins = (np.frombuffer(b"".join(opened.column(c).to_pylist()), t) for c, t in (("lead", bool), ("begins", np.int64)))
        self.leaf = np.where(lead, self.own.leaf, self.own.tail)
        self.asked: dict[int, np.ndarray] = {}
        self.common: dict[int, np.ndarray] = {}
        self.firsts: dict[int, np.ndarray] = {}
        for k in range(1, upto):
            self.asked[k] = self.keys(k)[0]
            self.common[k], self.firsts[k] = _answers(self.asked[k], replies, k)

    def keys(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places() if round_ == 1 else self.templates()

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of the lines with their places and leaf, and the lines as they are."""
        own = self.own
        line, place = own.of_words()
        word = mixed(self.leaf[line] * np.uint64(0xD6E8FEB86659FD93) + mixed(own.words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return np.concatenate([word, own.keys()]), np.concatenate([own.owner[line], own.owner])

    def templates(self) -> tuple[np.ndarray, np.ndarray]:
        """The fixed words of each line not common as it is, whole and less one of them; zero where they are too few."""
        own, words = self.own, len(self.own.words)
        size = np.diff(own.first)
        line, _ = own.of_words()
        fixed, settled = self.common[1][:words], self.common[1][words:]
        token = np.where(fixed, mixed(self.asked[1][:words] + np.uint64(1)), np.uint64(0))
        total = np.add.reduceat(token, own.first[:-1]) if len(size) else np.zeros(0, np.uint64)
        n = np.bincount(line[fixed], minlength=len(size))
        enough = np.maximum(FIXED * size, np.minimum(DEPTH + BEYOND, np.maximum(size - 1, 2 * DEPTH)))
        whole = np.where(~settled & (n >= enough), mixed(self.leaf ^ total), np.uint64(0))
        less = fixed & ~settled[line] & (n[line] - 1 >= enough[line])
        one_less = np.where(less, mixed((self.leaf[line] ^ (total[line] - token)) + np.uint64(7)), np.uint64(0))
        return np.concatenate([whole, one_less]), np.concatenate([own.owner, own.owner[line]])

    def dropped(self) -> np.ndarray:
        """Lines that belong to a template and do not stand in its first document."""
        own, words = self.own, len(self.own.words)
        n = len(own.owner)
        ids = own.ids[own.owner]
        line, _ = own.of_words()
        exact, whole = self.common[1][words:], self.common[2][:n]
        less = np.where(self.common[2][n:], self.firsts[2][n:], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(less, own.first[:-1]) if n else np.zeros(0, np.int64)
        some = np.bincount(line[self.common[2][n:]], minlength=n) > 0
        first = np.where(exact, self.firsts[1][words:], np.where(whole, self.firsts[2][:n], least))
        return (exact | whole | some) & (first != ids)


def _send(round_: int, buckets: int, least: int) -> Callable[..., pa.Table]:
    """A partition's keys of a round, each with at most `least` of its documents and the first of all of them.

    Whole texts with the replies of the first round are opened here.
    """

    def run(rows: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        if not rows.num_rows:
            return sent_table([])
        number = rows.column("part")[0].as_py()
        if round_ == 0:
            own = Lines.of(settled(rows))
            keys, owner = own.leaves()
        else:
            known = Known(rows if "lead" in rows.column_names else _open(rows, replies), replies, round_)
            own = known.own
            keys, owner = known.keys(round_)
        asked = np.flatnonzero(keys)
        keys, owner = keys[asked], owner[asked]
        order, runs, sizes = first_seen(keys)
        first = np.empty(len(keys), np.int64)
        if len(keys):
            first[order] = np.repeat(np.minimum.reduceat(own.ids[owner][order], runs), sizes)
        pick = _some_of_each(keys, own.digests[owner], least)
        key, digest, first, at = keys[pick], own.digests[owner[pick]], first[pick], asked[pick]
        return sent_table([
            (b, number, *packed_places(at[k]), key[k].tobytes(), digest[k].tobytes(), first[k].tobytes())
            for b, k in dealt_out(bucket_of(key, buckets))
        ])

    return run


def _alone(step: Callable[..., pa.Table]) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: step(rows)


def _common(round_: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """The entries of keys with `least` or more different documents, and each key's first document."""

    def run(rows: pa.Table) -> pa.Table:
        part, place, key = received(rows, np.uint64)
        digest, first = (np.concatenate([np.frombuffer(r, np.int64) for r in rows.column(c).to_pylist()]) for c in ("ids", "runs"))
        order, runs, sizes = first_seen(key)
        group = np.repeat(np.arange(len(runs)), sizes)
        seen = np.unique(np.stack([group, digest[order]], axis=1), axis=0)[:, 0]
        common = np.repeat(np.bincount(seen, minlength=len(runs)) >= least, sizes)
        stays = np.repeat(np.minimum.reduceat(first[order], runs), sizes)[common]
        part, place = part[order][common], place[order][common]
        # one entry of each part and key is enough for the part to know the key
        once = np.unique(np.stack([part, group[common]], axis=1), axis=0, return_index=True)[1]
        part, place, stays = part[once], place[once], stays[once]
        order = np.lexsort([place, part])
        part, place, stays = part[order], place[order], stays[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
        out = [(int(part[a]), round_, *packed_places(place[a:b]), stays[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _COMMON.types)], schema=_COMMON) if out else _COMMON.empty_table()

    return run


GONE = "part bigint, row bigint, begins binary, ends binary"
_GONE = pa.schema([("part", pa.int64()), ("row", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary())])


def _gone(opened: pa.Table, replies: pa.Table) -> pa.Table:
    """Where the dropped lines stand in each text that loses some."""
    if not opened.num_rows:
        return _GONE.empty_table()
    known = Known(opened, replies, 3)
    own = known.own
    at = np.flatnonzero(known.dropped())
    row, begin = known.rows[own.owner[at]], known.begins[at]
    end = begin + own.end[at] - own.begin[at]
    cuts = np.flatnonzero(np.diff(row, prepend=-1)).tolist() + [len(at)]
    spans = list(zip(cuts, cuts[1:]))
    columns = (
        np.full(len(spans), opened.column("part")[0].as_py()), row[cuts[:-1]],
        [begin[a:b].tobytes() for a, b in spans], [end[a:b].tobytes() for a, b in spans],
    )
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _GONE.types)], schema=_GONE)


def _edit(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, gone: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = settled(rows)
        cut = {r["row"]: [np.frombuffer(r[c], np.int64).tolist() for c in ("begins", "ends")] for r in gone.to_pylist()}
        texts, n_lines, dropped = [], [], []
        for k, text in enumerate(rows.column("text").to_pylist()):
            begins, ends = cut.get(k, ((), ()))
            # lines with a word; bytes know no white space but that between words
            whole = (text or "").encode()
            n_lines.append(sum(not not line.strip() for line in whole.split(b"\n")))
            dropped.append(len(begins))
            if begins:
                edited = b"".join(whole[a:b] for a, b in zip([0, *ends], [*begins, len(whole)]))
                # the last line of a text has no line feed of its own
                if whole[-1:] != b"\n" and edited[-1:] == b"\n":
                    edited = edited[:-1]
                text = edited.decode()
            texts.append(text)
        # the other columns as they are, but all nullable as declared
        others = rows.column("row").combine_chunks()
        fields = list(schema.field("row").type)
        others = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(others.flatten(), fields)], fields=fields)
        return pa.Table.from_arrays(
            [pa.array(texts, pa.string()), others, pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())], schema=schema
        )

    return run


def without_templates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_DOCS, counts: bool = True
) -> DataFrame:
    """All columns of docs, the text without recurring lines, and with `counts` n_lines and n_dropped."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(
        whole_id(docs, doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    )
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, chars // PART_CHARS)
    buckets = max(1, chars // 60 // BUCKET_LINES)

    def common(round_: int, sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_common(round_, least), COMMON)

    # the same exchange of the texts, and that of their looked-into lines, serve all steps
    whole = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).groupBy("part")
    leaves = common(0, whole.applyInArrow(_alone(_send(0, buckets, least)), SENT))
    opened = whole.cogroup(leaves.groupBy("part")).applyInArrow(_open, OPENED).groupBy("part")
    places = common(1, opened.applyInArrow(_alone(_send(1, buckets, least)), SENT))
    templates = common(2, opened.cogroup(places.groupBy("part")).applyInArrow(_send(2, buckets, least), SENT))
    gone = opened.cogroup(places.unionByName(templates).groupBy("part")).applyInArrow(_gone, GONE)
    out = f"text string, row {rows.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    edited = whole.cogroup(gone.groupBy("part")).applyInArrow(_edit(schema), out)
    return edited.select(
        *(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns),
        *(("n_lines", "n_dropped") if counts else ()),
    )
