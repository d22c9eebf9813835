"""Token alignment against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from saleroom.llm import align, queries
from tests.conftest import SMALL

FOLDER = queries.TOKENIZERS


@pytest.fixture(scope="module")
def makers():
    return align.byte_level(f"{FOLDER}/byte_bpe_50k.json"), align.piece_model(f"{FOLDER}/piece_bpe_32k.model")


def plain(texts, makers):
    """The rows that the operator should give, from texts alone."""
    a, b = (m() for m in makers)
    rows, pairs = [], []
    for text in texts:
        by_a, by_b = (a([text])[0], b([text])[0]) if text else ([], [])
        joined = [b"".join(x.entries[i] for i in ids) for x, ids in ((a, by_a), (b, by_b))]
        if any(j != b" " + (text or "").encode() for j in joined):
            by_a, by_b = [], []
        spans = []
        for x, ids in ((a, by_a), (b, by_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(x.entries[i]), i))
                at += len(x.entries[i])
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[",".join(str(i) for s, e, i in side if lo < e <= hi) for side in spans] for lo, hi in zip([0, *ends], ends)]
        links, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j][0] >= s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    links.append((i, spans[1][j][2]))
                j += 1
            j = min(j, len(spans[1]) - 1)
        pairs.append(links)
        digest = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else ""
        rows.append([len(by_a), len(by_b), len(ends), len(links), digest])
    count = Counter(p for links in pairs for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(*r[:4], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, pairs)]


def test_both_libraries_give_the_same_ids(makers):
    a = makers[0]()
    assert a.fast is not None
    letters = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B)]]
    draw = random.Random(4)
    texts = [f"{x}{x} a{x}b {x}9{x}\n{x} ' {x}" for x in letters]
    texts += ["".join(draw.choices(letters + list("  \n\t'stre aeinou") * 40, k=60)) for _ in range(3000)]
    wanted = [e.ids for e in a.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert a(texts) == wanted and not any(align._UNSETTLED.search(t) for t in texts)
    assert a(["漢字 Ⴀ𐐀 ✓"])[0] == a.model.encode(" 漢字 Ⴀ𐐀 ✓", add_special_tokens=False).ids


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_on_all_documents(spark, makers):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_cross_tokenizer(spark, SMALL).collect()}
    assert found == dict(zip(texts, plain(list(texts.values()), makers)))


ODD = [None, "", " ", "a <s> </s> <|endoftext|> <unk> \x00", "▁ under", "é漢🙂 \n\t ﬁ", "a  b   c", "tie", "tie", "word " * 9_000, "x" * 3_000, "<0x41>"]


@pytest.mark.parametrize("part_bytes", [1, 1 << 20])
def test_odd_texts_in_parts(spark, frame, makers, part_bytes):
    rows = [(None if t == " " else k, t, 1, 2, "x") for k, t in enumerate(ODD)]
    docs = frame("doc_id BIGINT, text STRING, part INT, n INT, places STRING", *rows)
    wanted = sorted(zip([r[0] for r in rows], plain(ODD, makers)), key=str)
    short = align.aligned(docs, *makers, lists=False, part_bytes=part_bytes).collect()
    assert sorted([(r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in short], key=str) == wanted
    whole = align.aligned(docs, *makers, part_bytes=part_bytes).collect()
    digests = {}
    for r in whole:
        cuts = list(zip(zip([0, *r["a_cuts"]], r["a_cuts"]), zip([0, *r["b_cuts"]], r["b_cuts"])))
        text = ";".join(",".join(map(str, r["a_ids"][x:y])) + "|" + ",".join(map(str, r["b_ids"][u:v])) for (x, y), (u, v) in cuts)
        digests[r["doc_id"]] = hashlib.sha256(text.encode()).hexdigest() if text else ""
    assert digests == {i: w[-1] for i, w in wanted}
    assert align.aligned(docs.limit(0), *makers).collect() == []
