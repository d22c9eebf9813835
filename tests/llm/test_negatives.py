"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleroom.llm import negatives

ROWS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute(rows, every, scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        new = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, new), new)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, k == label) for i, (k, w) in held.items() if i != a)
        for score, p, _ in [s for s in scored if s[2]][:5]:
            fit = [(s, i) for s, i, same in scored if not same and -80 * score <= -100 * s <= -100 * score]
            out |= {(a, p, rank, i, -score, -s) for rank, (s, i) in enumerate(fit[:5], 1)}
    return out


def mined(frame, rows, every, **how):
    made = frame(ROWS, *rows).select("*", *(F.lit(1).alias(c) for c in ("id", "v", "slab", "block", "rank", "anchor_id")))
    return [tuple(r) for r in negatives.hard_negatives(made, every, **how).collect()]


@pytest.mark.parametrize("kind", ["spread", "clustered", "few values"])
def test_like_brute_force(frame, kind):
    rng = np.random.default_rng(3)
    n, dim = 700, 6
    v = rng.normal(size=(n, dim))
    if kind == "clustered":
        v = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + 0.05 * v
    if kind == "few values":
        v = np.round(v) / 256
    v[200:430] = v[200]  # a third of all rows is one vector
    rows = [(i, v[i].tolist(), int(x)) for i, x in enumerate(rng.choice(5, n, p=[0.4, 0.3, 0.2, 0.09, 0.01]))]
    found = mined(frame, rows, 25, slab_rows=100)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 25)


def test_odd_rows(frame):
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 2), (1, [1.0], 1), (2, [0.9, 0.1, 7.0], 2), (3, [0.9, None], 2), (4, [math.nan, 1.0], 2), (5, [math.inf, 1.0], 2),
        (6, None, 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (8, [], 2), (9, [0.95, 0.0], 3), (10, [-1.0, -1.0], 4), (20, [1.0, 1.0], 4), (30, [], 5), (31, [], 5), (32, [0.0], 6), (33, [3e9, 1.0], 6),
    ]
    found = mined(frame, rows, 10, slab_rows=4)
    assert set(found) == brute(rows, 10) and len(found) == len(set(found))
    assert mined(frame, [], 10) == []
    assert mined(frame, [(0, [1.0], 1)], 10) == []


def test_boxes_bound_products_and_large_numbers():
    rng = np.random.default_rng(1)
    v = rng.integers(-1 << 40, 1 << 40, (500, 5))
    tree = negatives.Tree(*(x[np.concatenate(negatives.tiled(v, v[:, 0] % 3, np.arange(500), np.arange(500)))] for x in (v, v[:, 0] % 3, np.arange(500))))
    q = rng.integers(-1 << 20, 1 << 20, (7, 5))
    least, most = negatives.intervals(q, tree.lo, tree.hi)
    exact = q.astype(object) @ tree.vectors.astype(object).T
    assert (negatives.products(q, tree.vectors) == exact).all()
    for leaf in range(tree.leaves):
        inside = exact[:, leaf * negatives.LEAF : (leaf + 1) * negatives.LEAF]
        assert (least[:, leaf] <= inside.min(axis=1)).all() and (inside.max(axis=1) <= most[:, leaf]).all()
    assert (least[:, tree.root] <= exact.min(axis=1)).all()


def test_search_prunes_boxes():
    """On clustered vectors most leaves are never scored."""
    rng = np.random.default_rng(2)
    v = (256 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 8000)] * 4 + 0.05 * rng.normal(size=(8000, 8)))).astype(np.int64)
    labels = rng.integers(0, 3, 8000)
    order = np.concatenate(negatives.tiled(v, labels, np.arange(8000), np.arange(8000)))
    tree, scored = negatives.Tree(v[order], labels[order], np.arange(8000)[order]), []
    leaf = tree._leaf
    tree._leaf = lambda *a: scored.append(a[0]) or leaf(*a)
    least, most = negatives.intervals(v[:1], tree.lo, tree.hi)
    everything = {"id": None, "lo": -negatives._FAR, "hi": negatives._FAR, "kth": None, "kid": None}
    found = tree.search(v[0], int(labels[0]), 0, True, [everything], 5, least[0], most[0])[0]
    assert found == sorted(((int(v[0] @ v[i]), i) for i in range(1, 8000) if labels[i] == labels[0]), key=lambda x: (-x[0], x[1]))[:5]
    assert len(scored) < tree.leaves / 5
