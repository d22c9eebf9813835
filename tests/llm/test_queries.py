"""The queries on the small tables, against SQL or plain Python."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from saleroom.llm import queries
from tests.compare import differences, duck
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, name, folder=SMALL):
    return queries.QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.SQL[name]) == []


def base_counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, texts):
    for r in rows(spark, "op2_quality_rules"):
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert found == base_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (found[0] < 50 or 100 * found[4] > 50 * found[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts_follow_labels(spark):
    kept = {r["doc_id"]: r["kept"] for r in rows(spark, "op2_quality_rules", MEDIUM)}
    failed = {r["doc_id"] for r in rows(spark, "op2_quality_rules", MEDIUM) if r["base_failed"]}
    labels = [r for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect() if r["doc_id"] not in failed]
    right = sum(kept[r["doc_id"]] == (r["quality"] == 1) for r in labels)
    assert right / len(labels) > 0.97


def test_page_text(spark):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in rows(spark, "op3_html_extraction"):
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_classifier_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    found = rows(spark, "op4_quality_classifier", MEDIUM)
    assert len(found) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9


def test_repeats(spark, texts):
    seen = set()
    found = {r["doc_id"]: r for r in rows(spark, "op5_substring_dedup")}
    for doc_id in sorted(texts):
        words = WORD.findall(texts[doc_id])
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        r = found[doc_id]
        assert (r["n_words"], r["n_removed"]) == (len(words), sum(gone))
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    found = rows(spark, "op6_language_id", MEDIUM)
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert sum(r["accepted"] for r in found) / len(found) > 0.98


def test_line_templates(spark, texts):
    def mask(line):
        words = WORD.findall(line)
        fields = [bool(re.search("[0-9]", w)) for w in words]
        return tuple("<*>" if f and 10 * sum(fields) <= 4 * len(words) else w for w, f in zip(words, fields))

    docs, first = defaultdict(set), {}
    for doc_id in sorted(texts):
        for line in texts[doc_id].split("\n"):
            if WORD.search(line):
                docs[mask(line)].add(texts[doc_id])
                first.setdefault(mask(line), doc_id)
    for r in rows(spark, "op7_line_dedup"):
        lines = texts[r["doc_id"]].split("\n")
        gone = [WORD.search(x) and len(docs[mask(x)]) >= 10 and first[mask(x)] != r["doc_id"] for x in lines]
        assert r["text"] == "\n".join(x for x, g in zip(lines, gone) if not g)
        assert r["n_dropped"] == sum(map(bool, gone))


def test_licences(spark, texts):
    known = {
        "Licensed under CC BY-NC 4.0": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
        "Licensed under the Apache License, Version 2.0": "apache-2.0", "Released under the MIT License": "mit", "All rights reserved": "all-rights-reserved",
    }
    wanted = {
        (doc_id, k, family)
        for doc_id, text in texts.items()
        for k, line in enumerate(x for x in text.split("\n") if x.strip())
        for notice, family in known.items() if notice.lower() in line.lower()
    }
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in rows(spark, "op8_license_scans")} == wanted
    assert wanted


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark, texts):
    prints = {d: fingerprint(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in rows(spark, "op9_simhash"):
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == find(r["doc_id"])


def test_mix_meets_targets(spark):
    found = rows(spark, "op10_mixing", MEDIUM)
    by = defaultdict(list)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[(r["source_size"], r["target"])].append(r)
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    for (size, target), docs in by.items():
        assert target <= 2 * size
        assert abs(sum(r["taken"] for r in docs) - target) <= max(r["size"] for r in docs) / 2
