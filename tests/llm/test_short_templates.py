"""Templates of few words: one free place among seven, no fewer fixed words than that."""

from __future__ import annotations

import random

from saleroom.llm import lines

NAMES = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ron", "lia", "met", "sko", "pan", "dir")]


def dropped(frame, texts):
    found = lines.without_templates(frame("doc_id BIGINT, text STRING", *enumerate(texts)), counts=True)
    return {r["doc_id"]: r["n_dropped"] for r in found.collect()}


def test_seven_words_with_one_free_place(frame):
    """The free place outside both leaves, among the leading words, and with values frequent on their own."""
    draw = random.Random(1)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=7))
    texts = [f"Sent to you by {name} from here" for name in NAMES]
    texts += [f"{name} has left a note for you" for name in NAMES]
    texts += [f"We thank our reader {NAMES[k % 5]} for help\nbody of {word()} {word()}" for k in range(30)]
    texts += [f"We thank our {word()} {NAMES[k % 5]} {word()} {word()}" for k in range(60)]  # make those values frequent
    found = dropped(frame, texts)
    assert [sum(found[k] for k in range(a, a + 30)) for a in (0, 30, 60)] == [29, 29, 29]
    assert sum(found[k] for k in range(90, 150)) == 0


def test_fewer_fixed_words_are_no_template(frame):
    """Two free places among seven words, and one among six or fewer."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=7))
    texts = [f"This is a day {word()} {word()} again" for _ in range(30)]
    texts += [f"This is a {word()} day again" for _ in range(30)] + [f"Thank you for {word()}" for _ in range(30)]
    assert sum(dropped(frame, texts).values()) == 0
