"""Short texts, large numbers of buckets, repeated ids."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from saleroom.llm import language, lines, packed, quality, repeats


def test_one_letter_is_a_text():
    model = language.trained(["the house near the river a I"] * 30 + ["das haus am fluss é"] * 30, ["en"] * 30 + ["de"] * 30)
    names, scores, _ = model.named(pa.array(["a", "I", "é", "1", "", " ", None, "x.", "漢"]))
    assert [n == "und" for n in names] == [False, False, False, True, True, True, True, False, False]
    assert all(0 <= s <= 1 for s in scores)


def test_dealing_does_not_look_at_empty_buckets():
    start = time.perf_counter()
    dealt = packed.dealt_out(np.array([1 << 40, 7, 7, 1 << 50]))
    assert [(b, k.tolist()) for b, k in dealt] == [(7, [1, 2]), (1 << 40, [0]), (1 << 50, [3])]
    assert packed.dealt_out(np.zeros(0, np.int64)) == [] and time.perf_counter() - start < 1


def test_ids_that_are_no_numbers_are_refused(frame):
    docs = frame("doc_id STRING, text STRING", ("a", "b c"))
    for run in (repeats.without_repeats, lines.without_templates):
        with pytest.raises(TypeError):
            run(docs)


def test_a_repeated_id_is_one_training_row(spark, frame, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "trained", lambda x, y: seen.append((x.shape[0], y.tolist())))
    docs = frame("doc_id BIGINT, text STRING", *[(1, f"text {k}") for k in range(500)], (2, None), (2, "b"), (3, None))
    labels = frame("doc_id BIGINT, quality INT", (1, 1), (2, 0), (3, 1))
    quality.learned(docs, labels, quality.context_table(docs))
    assert seen[0][0] == 3 and sorted(seen[0][1]) == [0.0, 1.0, 1.0]
