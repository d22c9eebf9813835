"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked pairs.

Each text, with a space before it, is cut by tokenizer A and by tokenizer B. The byte offsets
where a token of either ends are joined (Acero, full outer, on the key of document and end);
at each such end the tokens that cover the piece before it are linked, and ends of both sides
close a group. So a document has one link per different end. Arrow does the work: lists are
flattened, their lengths summed up per document, and pairs counted with `Table.group_by` per
part; Spark adds the parts' counts.

A part is a run of documents of one task, closed after PART_BYTES of text. A part keeps its
different pairs once, and a document refers to them by place; so what is sent to the counts
and back is a row per part and different pair, and no document travels with its pairs' texts.

Null and empty texts have no tokens, and neither has a text that a tokenizer does not give
back byte for byte: counts are zero, lists empty, the digest is ''. Each row is a document of
its own, so repeated rows and null ids count like others. Very long texts are encoded whole,
one at a time. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.llm.tokens import pieces, small_batches
from saleroom.session import scratch_path

PART_BYTES = 6 << 20
_B_BITS = 20  # ids of B are below 2^20: a pair is one long

Encoder = Callable[[list[str]], list[list[int]]]


def byte_level_entries(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Its letters stand for bytes: printable Latin-1 characters for themselves, the others, in
    order, for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


# How a byte-level vocabulary cuts text into words, and the characters that both libraries class alike in it.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSETTLED = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u203a]")


class ByteLevel:
    """A byte-level BPE from the JSON of the `tokenizers` library. Encodes a space and the text.

    Where ids follow the merges' order and words are cut in the usual way, `tiktoken` gives the
    same ids in a third of the time. It takes the texts whose characters both libraries class
    alike (letters, digits, spaces); any other text, and any other model, goes to `tokenizers`.
    """

    def __init__(self, json_text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(json_text)
        self.model.encode_special_tokens = True
        self.entries = byte_level_entries(self.model.get_vocab(with_added_tokens=True))
        self.fast = self._ranked(json.loads(json_text))

    def _ranked(self, spec: dict) -> Callable[[str], list[int]] | None:
        vocabulary, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = [vocabulary.get("".join(m), -1) for m in merges]
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not usual or spec["model"].get("ignore_merges") or ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        import tiktoken

        added = {t["id"] for t in spec.get("added_tokens") or []}
        ranks = {self.entries[i]: i for i in vocabulary.values() if i not in added}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        slow = []
        for k, t in enumerate(texts):
            if self.fast is None or _UNSETTLED.search(t):
                slow.append(k)
            else:
                out[k] = self.fast(" " + t)
        for k, e in zip(slow, self.model.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out


class Pieces:
    """A sentencepiece model from its bytes. It adds the space by itself."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        self.entries = [
            bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(ids, map(self.model.id_to_piece, ids))
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def flat(ids: list[list[int]]) -> tuple[pa.Array, pa.Array]:
    """(all ids one after another, index of the text that each belongs to)."""
    lists = pa.array(ids, pa.list_(pa.int32()))
    return pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())


def sums_by(values: pa.Array, parent: pa.Array, n: int) -> np.ndarray:
    return np.bincount(parent.to_numpy(), weights=values.to_numpy(), minlength=n).astype(np.int64)


def bytes_of(entries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries laid end to end, and where each begins (and the last ends)."""
    if not len(entries):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, raw = entries.cast(pa.large_binary()).buffers()
    return np.frombuffer(raw, np.uint8) if raw.size else np.zeros(0, np.uint8), np.frombuffer(at, np.int64)[: len(entries) + 1]


def given_back(ids: pa.Array, parent: pa.Array, entries: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text are the text, byte for byte."""
    joined, at = bytes_of(entries.take(ids))
    found = sums_by(pa.array(np.diff(at)), parent, len(texts))
    wanted = np.frombuffer(b"".join(texts), np.uint8)
    if (found == [len(t) for t in texts]).all():
        wrong = np.flatnonzero(joined[: len(wanted)] != wanted)
        out = np.ones(len(texts), bool)
        out[np.searchsorted(np.cumsum(found), wrong, "right")] = False
        return out
    ends = np.cumsum(found)
    return np.array([joined[e - n : e].tobytes() == t for e, n, t in zip(ends.tolist(), found.tolist(), texts)], bool)


def joined_ends(sizes_a: pa.Array, parent_a: pa.Array, sizes_b: pa.Array, parent_b: pa.Array) -> pa.Table:
    """One row per different token end, in order: doc, token of A and of B over the piece before it, cut (both end).

    The key of an end is its offset among all the texts' bytes laid end to end: it names the
    document as well, as both sides cover the same bytes.
    """
    a = pa.table({"end": pc.cumulative_sum(sizes_a), "a": np.arange(len(sizes_a)), "doc": parent_a})
    b = pa.table({"end": pc.cumulative_sum(sizes_b), "b": np.arange(len(sizes_b)), "doc_b": parent_b})
    both = a.join(b, "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    cut = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    return pa.table({
        "doc": pc.coalesce(both["doc"], both["doc_b"]), "cut": cut,
        "a": pc.fill_null_backward(both["a"]), "b": pc.fill_null_backward(both["b"]),
    })


def group_digests(codes_a: np.ndarray, codes_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, words: pa.Array, stops: np.ndarray) -> list[str]:
    """The digest of `a1,a2|b1;a3|b2,b3` of each text, '' for one without tokens.

    group_*: the number of groups, over all texts, that end before each token. words: at an
    even code an id with a comma, and after it the same id with the sign that ends its side of
    a group. stops: the number of groups before each text, and of all.
    """
    count_a, count_b = np.bincount(group_a, minlength=stops[-1]), np.bincount(group_b, minlength=stops[-1])
    before = np.concatenate([[0], np.cumsum(count_a + count_b)])
    before_a = np.cumsum(count_a) - count_a
    order = np.empty(len(codes_a) + len(codes_b), np.int64)
    order[np.arange(len(codes_a)) + (before[:-1] - before_a)[group_a]] = codes_a
    order[np.arange(len(codes_b)) + (before_a + count_a)[group_b]] = codes_b
    order[before[:-1] + count_a - 1] += 1
    order[before[1:] - 1] += 1
    joined, at = bytes_of(words.take(pa.array(order)))
    cuts = at[before[stops]].tolist()
    return [hashlib.sha256(joined[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]


def planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, all their first bytes first: higher bytes are mostly zero and pack well."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0].astype(np.int64)


class Aligner:
    """Both tokenizers and their entries' sizes; made once per worker."""

    def __init__(self, a: Callable[[], Encoder], b: Callable[[], Encoder]) -> None:
        self.a, self.b = a(), b()
        self.entries = [pa.array(x.entries, pa.binary()) for x in (self.a, self.b)]
        self.sizes = [pc.binary_length(x).cast(pa.int64()) for x in self.entries]
        n_a, n_b = map(len, self.entries)
        self.words = pa.array([f"{i}{x}".encode() for n, end in ((n_a, "|"), (n_b, ";")) for i in range(n) for x in (",", end)], pa.binary())
        if len(self.b.entries) >= 1 << _B_BITS:
            raise ValueError(f"tokenizer B has {len(self.b.entries)} ids, more than {(1 << _B_BITS) - 1}")

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by A and by B; none where either does not give the text back."""
        full = [k for k, t in enumerate(texts) if t]
        held = [texts[k] for k in full]
        wanted = [b" " + t.encode() for t in held]
        both, right = [], np.ones(len(full), bool)
        for encode, entries in zip((self.a, self.b), self.entries):
            both.append(encode(held))
            right &= given_back(*flat(both[-1]), entries, wanted)
        out: tuple[list, list] = ([[] for _ in texts], [[] for _ in texts])
        for i, k in enumerate(full):
            if right[i]:
                out[0][k], out[1][k] = both[0][i], both[1][i]
        return out

    def rows(self, texts: list[str | None], lists: bool) -> tuple[pa.Table, pa.Table]:
        """(a row per text, its links counted: doc, pair, times)."""
        n = len(texts)
        by_a, by_b = self.tokens(texts)
        (ids_a, parent_a), (ids_b, parent_b) = flat(by_a), flat(by_b)
        ends = joined_ends(self.sizes[0].take(ids_a), parent_a, self.sizes[1].take(ids_b), parent_b)
        pair = pc.add(pc.shift_left(ids_a.cast(pa.int64()).take(ends["a"]), _B_BITS), ids_b.cast(pa.int64()).take(ends["b"]))
        links = pa.table({"doc": ends["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        doc, cut = ends["doc"].to_numpy(), ends["cut"].to_numpy()
        count = lambda parent: np.bincount(parent, minlength=n).astype(np.int64)
        out = {"n_a": count(parent_a.to_numpy()), "n_b": count(parent_b.to_numpy()), "n_groups": count(doc[cut]), "n_links": count(doc)}
        # tokens of either side up to the end of each group
        last_a, last_b = ends["a"].to_numpy()[cut], ends["b"].to_numpy()[cut]
        where = np.concatenate([[0], np.cumsum(out["n_groups"])])
        if lists:
            kind = lambda ids: pa.array(ids, pa.list_(pa.int32()))
            out |= {"a_ids": kind(by_a), "b_ids": kind(by_b)}
            for name, last, size in (("a_cuts", last_a, out["n_a"]), ("b_cuts", last_b, out["n_b"])):
                base = np.repeat(np.cumsum(size) - size, out["n_groups"])
                out[name] = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(last + 1 - base, pa.int32()))
        else:
            group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
            codes_b = 2 * (ids_b.to_numpy() + np.int64(len(self.entries[0])))
            out["groups_sha256"] = group_digests(2 * ids_a.to_numpy().astype(np.int64), codes_b, group_a, group_b, self.words, where)
        return pa.table(out), links


_LISTS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"


def _closed(part: int, held: list[tuple[pa.Array, pa.Table, pa.Table]]) -> pa.Table:
    """The documents of a part, with their pairs as places in the part's list, and a last row with that list."""
    pairs = pa.concat_tables([links for _, _, links in held]).column("pair")
    partial = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    known = partial["pair"].combine_chunks()
    out = []
    for ids, docs, links in held:
        place = pc.index_in(links["pair"], value_set=known).to_numpy()
        times, cuts = links["count_all"].to_numpy(), np.searchsorted(links["doc"].to_numpy(), np.arange(docs.num_rows + 1)).tolist()
        spans = list(zip(cuts, cuts[1:]))
        docs = docs.append_column("places", pa.array([planes(place[x:y]) for x, y in spans], pa.binary()))
        docs = docs.append_column("times", pa.array([planes(times[x:y]) for x, y in spans], pa.binary()))
        out.append(docs.append_column("doc_id", ids).append_column("part", pa.array(np.full(docs.num_rows, part))))
    code = known.to_numpy()
    listed = {"a": [planes(code >> _B_BITS)], "b": [planes(code & ((1 << _B_BITS) - 1))], "n": [planes(partial["count_all"].to_numpy())]}
    out.append(pa.table({"part": pa.array([part], pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in listed.items()}))
    return pa.concat_tables(out, promote_options="default")


def in_parts(docs: DataFrame, a: Callable[[], Encoder], b: Callable[[], Encoder], lists: bool, part_bytes: int) -> DataFrame:
    """Every document's tokens and pairs, and every part's pairs, written to the shared folder: texts are encoded once."""
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    extra = _LISTS if lists else "groups_sha256 string"
    schema = f"part bigint, doc_id {id_type}, {_COUNTS}, {extra}, places binary, times binary, a binary, b binary, n binary"
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, size, held = Aligner(a, b), TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text")
                held.append((piece.column("doc_id"), *aligner.rows(texts.to_pylist(), lists)))
                size += texts.nbytes
                if size >= part_bytes:
                    yield from _closed(part, held).select(names).to_batches()
                    part, size, held = part + 1, 0, []
        if held:
            yield from _closed(part, held).select(names).to_batches()

    path = scratch_path(docs.sparkSession, "aligned")
    docs.mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, place, a, b, n of every pair that a part has."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b, n = (from_planes(row[k]) for k in ("a", "b", "n"))
            cols = [np.full(len(a), row["part"]), np.arange(len(a)), a.astype(np.int32), b.astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "place", "a", "b", "n"])


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, n_docs: how many documents hold the pair linked, over the whole corpus."""
    listed = parts.where(F.col("n").isNotNull()).select("part", "a", "b", "n").mapInArrow(_listed_pairs, "part bigint, place bigint, a int, b int, n bigint")
    return listed.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def _scored(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = 1 + (pc.max(answers["place"]).as_py() if answers.num_rows else -1)
        count, best = np.zeros(n, np.int64), np.zeros(n, bool)
        at = answers["place"].to_numpy()
        count[at], best[at] = answers["n_docs"].to_numpy(), answers["is_best"].to_numpy()
        sums, bests = [], []
        for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist()):
            place, often = from_planes(places), from_planes(times)
            sums.append(int((count[place] * often).sum()))
            bests.append(int(often[best[place]].sum()))
        return docs.select(names).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return run


def aligned(
    docs: DataFrame,
    a: Callable[[], Encoder],
    b: Callable[[], Encoder],
    doc_id: str = "doc_id",
    text: str = "text",
    lists: bool = True,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum of every document, and its alignment.

    lists: the alignment is a_ids, b_ids and, for each group, the number of tokens of either
    side up to its end (a_cuts, b_cuts). Otherwise it is groups_sha256, the digest of
    `a1,a2|b1;a3|b2,b3`, and the lists never leave the tasks that made them.

    a, b: functions that make the encoders on a worker; `entries` of an encoder are its ids' bytes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = in_parts(rows, a, b, lists, part_bytes)
    counts = pair_counts(parts)
    # at most one row per id of A
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    counts = counts.join(F.broadcast(best), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))
    listed = parts.where(F.col("n").isNotNull()).select("part", "a", "b", "n").mapInArrow(_listed_pairs, "part bigint, place bigint, a int, b int, n bigint")
    answers = listed.select("part", "place", "a", "b").join(counts, ["a", "b"]).select("part", "place", "n_docs", "is_best")
    out = [f for f in parts.schema.fields if f.name not in ("part", "places", "times", "a", "b", "n")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", n_best bigint, count_sum bigint"
    held = parts.where(F.col("n").isNull()).drop("a", "b", "n")
    return held.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scored([f.name for f in out]), schema)


def byte_level(path: str) -> Callable[[], Encoder]:
    """A's maker: the vocabulary file is read here and travels with the tasks, so workers need no copy of it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return lambda: ByteLevel(text)


def piece_model(path: str) -> Callable[[], Encoder]:
    with open(path, "rb") as f:
        model = f.read()
    return lambda: Pieces(model)
