"""Line templates do not depend on what else their leaf holds."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from saleroom.llm import lines

NAMES = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "sa", "no", "be", "vi", "du") for b in ("ron", "lia", "met", "sko", "pan", "dir", "wes", "zul", "fay", "hob")]


def edited(frame, texts):
    found = lines.without_templates(frame("doc_id BIGINT, text STRING", *enumerate(texts)), counts=True)
    return {r["doc_id"]: r for r in found.collect()}


def noise(draw, n, start="This is a"):
    """Eight-word lines of one leaf, all different."""
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=6))
    return [f"{start} {word()} {word()} {word()} {word()} {word()}" for _ in range(n)]


@pytest.mark.parametrize("others", [10, 300, 10_000])
def test_one_template_among_other_lines(frame, others):
    draw = random.Random(others)
    texts = [f"{noise(draw, 1, 'own words here')[0]}\nThis is a message from {draw.choice(NAMES)} the moderator" for _ in range(100)]
    rest = noise(draw, others)
    texts += ["\n".join(rest[k : k + 10]) for k in range(0, others, 10)]
    found = edited(frame, texts)
    assert [found[k]["n_dropped"] for k in range(100)] == [0] + [1] * 99
    assert sum(found[k]["n_dropped"] for k in range(100, len(texts))) == 0


def test_three_templates_in_one_leaf(frame):
    draw = random.Random(3)
    kinds = ["This is a message from {} the moderator", "This is a {} offer for our readers", "This is a note that {} left today"]
    texts = [kinds[k % 3].format(NAMES[k]) for k in range(90)] + noise(draw, 200)
    found = edited(frame, texts)
    assert [found[k]["n_dropped"] for k in range(90)] == [0] * 3 + [1] * 87
    assert sum(found[k]["n_dropped"] for k in range(90, len(texts))) == 0


def test_names_in_leading_places(frame):
    draw = random.Random(4)
    texts = [f"{NAMES[k]} wrote a comment on this page today" for k in range(60)] + [f"Dear {NAMES[k]} your order is on its way" for k in range(60)] + noise(draw, 100)
    found = edited(frame, texts)
    assert sum(found[k]["n_dropped"] for k in range(120)) == 118
    assert sum(found[k]["n_dropped"] for k in range(120, len(texts))) == 0


def test_a_field_of_frequent_values(frame):
    """Each name is frequent in the leaf, but in no ten documents within the template."""
    draw = random.Random(5)
    texts = [f"This is a message from {NAMES[k % 5]} the moderator" + " ." * (k % 1) for k in range(40)]
    texts = [f"{t}\nbody {k} {NAMES[k]} only" for k, t in enumerate(texts)]
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=6))
    texts += [f"This is a {word()} {word()} {NAMES[k % 5]} {word()} {word()}" for k in range(60)]
    found = edited(frame, texts)
    assert [found[k]["n_dropped"] for k in range(40)] == [0] + [1] * 39
    assert sum(found[k]["n_dropped"] for k in range(40, len(texts))) == 0


def test_clean_lines_stay(frame):
    """Lines that share some words with a template, and sentences over a small vocabulary."""
    draw = random.Random(6)
    vocabulary = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    vocabulary = [w.replace("0", "o") for w in vocabulary]
    texts = ["\n".join(" ".join(draw.choices(vocabulary, k=draw.randint(5, 14))) for _ in range(8)) for _ in range(150)]
    found = edited(frame, texts)
    assert sum(r["n_dropped"] for r in found.values()) == 0


def test_rounds_do_not_depend_on_the_order_of_rows():
    """A shuffle hands a partition's rows over in any order; every round must see the same places."""
    rows = [(k % 7 if k % 5 else None, f"line {k}\nthe same words in every text {k}" if k % 3 else None, 0) for k in range(40)]
    make = lambda order: pa.table({"doc_id": pa.array([rows[k][0] for k in order], pa.int64()), "text": pa.array([rows[k][1] for k in order], pa.string()), "part": pa.array([0] * len(order), pa.int64())})
    order = list(range(40))
    send, one = lines._send(0, 3, 5), lines._send(1, 3, 5)
    first = send(make(order)).sort_by("bucket").to_pylist()
    replies = lines._common(0, 5)(send(make(order)))
    second = one(make(order), replies).sort_by("bucket").to_pylist()
    for seed in range(3):
        random.Random(seed).shuffle(order)
        assert send(make(order)).sort_by("bucket").to_pylist() == first
        assert one(make(order), replies).sort_by("bucket").to_pylist() == second
