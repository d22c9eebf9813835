"""The mix against a plain solution of the same dual, document by document."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from saleroom.llm import mixing


def plain_rates(docs: list[tuple[str, int]], target: dict[str, float]) -> list[float]:
    """Rates of (source, size) documents: damped Newton steps on all multipliers of the dual at once."""
    size = np.array([n for _, n in docs], float)
    lengths = [max(n, 1).bit_length() - 1 for _, n in docs]
    strata, names = sorted(set(lengths)), sorted(target)
    pick = np.zeros((len(docs), len(names) + len(strata)))
    for i, ((s, _), j) in enumerate(zip(docs, lengths)):
        pick[i, names.index(s)] = pick[i, len(names) + strata.index(j)] = 1
    words = size @ pick
    wanted = np.concatenate([[target[s] for s in names], 1.5 * words[len(names) :]])
    soft = np.concatenate([np.zeros(len(names)), mixing.SLACK * wanted[len(names) :]])

    def value(x):
        m = pick @ x
        mass = np.where(m > math.log(2), 2 * (1 + m - math.log(2)), np.exp(np.minimum(m, math.log(2))))
        return x @ wanted - (soft * x * x).sum() / 2 - size @ mass

    x = np.zeros(pick.shape[1])
    for _ in range(500):
        m = pick @ x
        rate = np.minimum(2, np.exp(m))
        slope = wanted - soft * x - pick.T @ (size * rate)
        bend = pick.T @ (pick * (size * rate * (m < math.log(2)))[:, None]) + np.diag(soft + 1e-6)
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        while value(x + step) < value(x) - 1e-9:
            step /= 2
        x = x + step
    assert np.abs(slope).max() < 1e-3
    return np.minimum(2, np.exp(pick @ x)).tolist()


@pytest.fixture(scope="module")
def documents():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    # `a` has short texts, `b` long ones, so that source and length pull against each other
    for source, count, most in (("a", 60, 12), ("b", 50, 90), ("c", 80, 60), ("d", 30, 25)):
        for size in rng.integers(1, most, count).tolist():
            rows.append((n, source, int(size)))
            n += 1
    return rows


def test_rates_solve_the_dual(spark, frame, documents):
    found = {r["doc_id"]: r for r in mixing.mixed(frame("doc_id BIGINT, text STRING, source STRING", *((d, "w " * n, s) for d, s, n in documents))).collect()}
    target = {s: found[d]["target"] for d, s, _ in documents}
    wanted = plain_rates([(s, n) for _, s, n in documents], target)
    got = [found[d]["rate"] for d, _, _ in documents]
    assert got == pytest.approx(wanted, abs=1e-4)
    # the rates of a source differ by length, and meet its target together
    by = defaultdict(set)
    for (_, s, _), r in zip(documents, got):
        by[s].add(round(r, 6))
    assert max(map(len, by.values())) > 3
    for s, t in target.items():
        assert sum(n * r for (_, o, n), r in zip(documents, got) if o == s) == pytest.approx(t)


def test_rounding_goes_by_turn(spark, frame, documents):
    found = mixing.mixed(frame("doc_id BIGINT, text STRING, source STRING", *((d, "w " * n, s) for d, s, n in documents))).collect()
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    for rows in by.values():
        left = rows[0]["target"] - sum(math.floor(r["rate"] + 1e-9) * r["size"] for r in rows)
        turn = []
        for r in rows:
            digest = hashlib.md5(str(r["doc_id"]).encode()).hexdigest()
            turn.append((int(digest[:8], 16) / 2**32 / max(r["rate"] - math.floor(r["rate"] + 1e-9), 1e-9), digest, r))
        before = 0
        for _, _, r in sorted(turn, key=lambda x: x[:2]):
            whole = math.floor(r["rate"] + 1e-9)
            more = whole < 2 and 2 * before + r["size"] <= 2 * left
            assert r["copies"] == whole + more
            before += r["size"] if whole < 2 else 0
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-6


def test_shares_out_of_reach(spark):
    """One length per source: the strata give way to the sources' targets, and the steps end."""
    rows = [("a", 10, [10, 0], 1.0), ("b", 10, [0, 10], 20.0), ("c", 0, [0, 0], 0.0)]
    targets = spark.createDataFrame(rows, "source STRING, source_size BIGINT, masses ARRAY<BIGINT>, target DOUBLE")
    rates = {r["source"]: r["rates"] for r in mixing.balanced(targets).collect()}
    assert rates["a"][0] == pytest.approx(0.1) and rates["b"][1] == pytest.approx(2.0) and rates["c"] == [0.0, 0.0]
