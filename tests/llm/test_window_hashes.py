"""Repeated windows with nearly the same hash."""

from __future__ import annotations

from saleroom.llm import rules
from tests.llm.test_methods import DOCS


def test_windows_are_compared_on_64_bits(spark, frame):
    # two windows whose hashes share their first 40 bits
    docs = frame(DOCS, (1, "w279699 x y and w1902338 x y"), (2, "a b c a b c"))
    assert [r["n_repeat_words"] for r in rules.measured(docs).orderBy("doc_id").collect()] == [0, 6]
