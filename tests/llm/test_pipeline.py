"""The pipeline on the small tables, its stages held against plain Python over their own input."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from saleroom.llm import language
from tests.conftest import SMALL
from tests.llm.test_queries import WORD, fingerprint


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs))
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] or "" for r in frame.select("doc_id", "text").collect()}


def test_stages_in_order(kept):
    assert [n for n, _ in kept[1:]] == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    for _, frame in kept[1:-1]:
        assert frame.columns == kept[0][1].columns


def test_language_stage(spark, kept):
    before = kept[0][1]
    model = language.learned_from(before, allowed=language.training_rows())
    wanted = {r["doc_id"] for r in language.identified(before, model).collect() if r["accepted"]}
    assert set(texts(kept[1][1])) == wanted
    assert len(wanted) >= 0.98 * before.count()


def test_line_stage(kept):
    before, after = texts(kept[1][1]), texts(kept[2][1])
    assert set(before) == set(after)
    for doc_id, text in after.items():
        left = iter(before[doc_id].split("\n"))
        assert text == "" or all(line in left for line in text.split("\n"))  # lines of the input, in order
    assert any(before[d] != after[d] for d in before)
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2][1].collect())


def test_near_duplicate_stage(kept):
    """Every pair of different fingerprints compared: the smallest id of each class stays."""
    before, after = texts(kept[2][1]), set(texts(kept[3][1]))
    prints = {d: fingerprint(t) for d, t in before.items()}
    root = {d: d for d in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in before:
        for b in before:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {d for d in before if find(d) == d}
    assert len(after) < len(before)


def test_decontamination_stage(spark, kept):
    before, after = texts(kept[3][1]), set(texts(kept[4][1]))
    def shingles(text):
        words = WORD.findall(text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    bench = [shingles(r["text"] or "") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaky = {d for d, t in before.items() if any(b and len(b & shingles(t)) >= 0.8 * len(b) for b in bench)}
    assert set(before) - after == leaky


def test_mixing_stage(kept):
    before, mix = texts(kept[4][1]), kept[5][1].collect()
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * len(WORD.findall(before[r["doc_id"]])) for r in mix)
    assert {r["doc_id"]: r["text"] for r in mix}.items() <= before.items()
    by = defaultdict(list)
    for r in mix:
        by[r["source"]].append(r)
    sizes = defaultdict(list)
    for r in kept[4][1].collect():
        sizes[r["source"]].append(len(WORD.findall(r["text"] or "")))
    for source, rows in by.items():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(sizes[source]) / 2 + 1e-6


def test_run_is_the_stages(spark, kept):
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(ran.select("doc_id", "taken").collect()) == sorted(kept[5][1].select("doc_id", "taken").collect())
