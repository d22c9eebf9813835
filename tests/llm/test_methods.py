"""The methods themselves, on small cases made for them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from saleroom.llm import components, language, leaks, licenses, lines, mixing, pages, repeats, rules, simhash

DOCS = "doc_id BIGINT, text STRING"


def words(n, seed, stem="w"):
    r = random.Random(seed)
    return [stem + "".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def test_vote_model_learns_which_rules_are_right():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        good = r.random() < 0.7
        votes = tuple(-1 if r.random() < 0.2 else int(good if r.random() < right else not good) for right in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    model = rules.fitted(sorted(counts.items()), 3)
    assert model.prior == pytest.approx(0.7, abs=0.06)
    assert [sum(x) / 2 for x in model.right] == pytest.approx([0.95, 0.9, 0.6], abs=0.07)
    assert rules.fitted([], 2).prior == 0.8


def test_a_leak_may_miss_a_fifth(spark, frame):
    item = words(25, 1)  # 21 shingles, 4 may be missing
    cut = item[:21]  # 17 shingles: 17/21 = 0.81
    less = item[:20]  # 16/21 = 0.76
    long = words(3000, 2) + cut + words(3000, 3)
    docs = frame(DOCS, (1, " ".join(long).upper()), (2, " ".join(words(50, 4) + less)), (3, None), (4, ""), (None, " ".join(item)))
    items = frame("item_id BIGINT, text STRING", (7, " ".join(item)), (8, "too short"), (9, None))
    for most in (10**6, 0):  # broadcast and shuffled
        found = {tuple(r) for r in leaks.leaks(docs, items, broadcast_rows=most).select("doc_id", "item_id", "n_shared", "n_shingles").collect()}
        assert found == {(1, 7, 17, 21), (None, 7, 21, 21)}
    assert sorted(r["doc_id"] for r in leaks.decontaminated(docs, items).collect()) == [2, 3, 4]


def test_sketches_cannot_miss(spark, frame):
    rows = frame("item_id BIGINT, shingle BIGINT", *((n, 1000 * n + k) for n in (1, 4, 9, 16, 30) for k in range(n)))
    kept = {r["item_id"]: r["n"] for r in leaks.sketches(rows, 0.8).groupBy("item_id").agg(F.count("*").alias("n")).collect()}
    for n, k in kept.items():
        assert k == n or k > n - np.ceil(0.8 * n - 1e-9)


def test_tree_visits_reach_every_neighbour():
    r = np.random.default_rng(0)
    points = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    points = np.concatenate([points, points[:500] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))])
    for k, mask in enumerate(simhash.masks()):
        tree = simhash.Tree(points[:800], mask, 6, k)
        at, leaf, home = tree.shards(points, 1)
        assert sorted(at[home]) == list(range(len(points)))  # one home each
        own = dict(zip(at[home], leaf[home]))
        seen = set(zip(at.tolist(), leaf.tolist()))
        for i in range(500):
            if ((points[i] ^ points[3000 + i]) & np.uint64(mask)).item().bit_count() <= 1:
                assert (3000 + i, own[i]) in seen and (i, own[3000 + i]) in seen


def test_shard_groups_against_brute_force():
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 40, (60, 3)).astype(np.uint64)).sum(axis=1) for c in centres]))
    labels = simhash.grouped(fps, np.ones(len(fps), bool), 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    reach = near
    while True:
        more = (reach.astype(int) @ near.astype(int)) > 0
        if (more == reach).all():
            break
        reach = more
    assert ((labels[:, None] == labels[None, :]) == reach).all()


def test_components_of_chains_and_stars(spark, frame):
    chain = [(k, k + 1) for k in range(1, 40)]
    star = [(100, k) for k in range(101, 140)]
    found = {r["node"]: r["root"] for r in components.components(frame("a BIGINT, b BIGINT", *chain, *star, (7, 7))).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}}
    assert components.components(frame("a BIGINT, b BIGINT")).count() == 0


def test_repeats_across_parts_and_within(spark, frame, monkeypatch):
    monkeypatch.setattr(repeats, "PART_CHARS", 400)
    monkeypatch.setattr(repeats, "BUCKET_WORDS", 20)
    passage = words(30, 1)
    rows = [(k, " ".join(words(17 + k, 100 + k) + passage + words(9, 200 + k))) for k in range(12)]
    rows += [(50, " ".join(passage[:19])), (51, " ".join(passage[5:25] + ["x"] + passage[5:25])), (52, None), (None, " ".join(passage))]
    found = {r["doc_id"]: r for r in repeats.without_repeats(frame(DOCS, *rows)).collect()}
    assert found[None]["n_removed"] == 0  # null ids come first
    assert all(found[k]["n_removed"] == 30 for k in range(12))
    assert found[50]["n_removed"] == 0 and found[51]["n_removed"] == 40 and found[51]["kept"] == "x"
    assert (found[52]["n_words"], found[52]["kept"]) == (0, "")


def test_variable_fields_make_a_template(spark, frame):
    names = words(40, 3, "name")
    rows = [(k, f"{' '.join(words(8, k))}\nPosted here by {names[k]} on page {k}\nEnd {k} of {' '.join(words(5, 500 + k))}") for k in range(40)]
    found = {r["doc_id"]: r["text"] for r in lines.without_templates(frame(DOCS, *rows)).collect()}
    assert "Posted here" in found[0]
    assert all("Posted here" not in found[k] for k in range(1, 40))
    assert all(found[k].count("\n") == 1 and f"End {k} of" in found[k] for k in range(1, 40))  # too little of it is fixed


def test_lines_of_numbers_are_no_template(spark, frame):
    rows = [(k, f"Table {k} follows now here\n{k} {k + 1} {k * k}\n7 7 7") for k in range(20)]
    found = {r["doc_id"]: r["text"] for r in lines.without_templates(frame(DOCS, *rows)).collect()}
    assert found[0] == rows[0][1]
    assert all(found[k] == f"{k} {k + 1} {k * k}" for k in range(1, 20))


def test_copies_make_no_template(spark, frame):
    text = "\n".join(" ".join(words(6, k)) for k in range(4))
    rows = [(k, text) for k in range(30)]
    assert {r["text"] for r in lines.without_templates(frame(DOCS, *rows)).collect()} == {text}


def test_site_templates_go(spark, frame):
    offer = "<div><p>Our offer of the week, call now</p></div>"
    page = "<html><body>{}<div><p>Story {} in full.</p><p>Second&nbsp;part&hellip;</p></div></body></html>"
    rows = [(k, f"https://a.example/{k}", page.format(offer, k)) for k in range(8)] + [(9, "https://b.example/", page.format(offer, 9))]
    found = {r["page_id"]: r["text"] for r in pages.main_text(frame("page_id BIGINT, url STRING, html STRING", *rows)).collect()}
    assert found[3] == "Story 3 in full.\n\nSecond part…"
    assert found[9].startswith("Our offer")  # one page makes no template


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain < text &amp; more", "plain < text & more"),
    ("<nav>menu</nav><article><header><h1>Title</h1></header><p>One<br>two<p>Three</article><footer>x</footer>", "Title\n\nOne two\n\nThree"),
    ("<article><p>Kept</p><div class='comments'><p>A reader</p></div><form>f</form><script>if (a</b) {}</script></article>", "Kept"),
    ("<div class=ad>advert<article><p>Inside an unclosed advert</p></article>", "Inside an unclosed advert"),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table></main>", "a\n\nb\n\n1 2"),
    ("<header>Site</header><div id=cookie-notice>We</div><p>Body <b>bold</b> text</p><aside>s</aside>", "Body bold text"),
    ("<article><p>Cut of", "Cut of"),
])
def test_one_page(source, text):
    assert pages.read(source).text() == text


def test_language_rejects_what_it_does_not_know():
    r = random.Random(2)
    made = {"aa": "badagakama", "ee": "zexewevely", "oo": "potosonoro"}
    texts, labels = [], []
    for lang, letters in made.items():
        for _ in range(60):
            texts.append(" ".join("".join(r.choice([letters[i : i + 2] for i in range(0, 10, 2)]) for _ in range(3)) for _ in range(20)))
            labels.append(lang)
    model = language.trained(texts, labels)
    name, score, ok = model.named(pa.array([texts[0], texts[70], None, "", "123 !!", texts[130].upper()]))
    assert name == ["aa", "ee", "und", "und", "und", "oo"]
    assert list(ok) == [True, True, False, False, False, True] and score[2] == 0
    assert language.trained([], []).named(pa.array(["text"]))[0] == ["und"]


def test_licence_families_and_plain_lines():
    model = licenses.trained([" ".join(words(12, k)) for k in range(400)])
    lines_ = ["Released under the MIT License.", "licensed under cc by-sa 4.0", "The city of Apache Junction grew", "Licensed plumbers work under pressure", "", "This work is licensed under the GNU General Public License, version 3."]
    g = licenses.grams(pa.array(lines_))
    p = model.probabilities(g)
    found = {}
    for k in range(len(p)):
        best = int(p[k, :-1].argmax())
        family = model.families[best]
        if p[k, best] >= model.level and licenses.confirmed(g, k, family, licenses.template_pairs()) >= licenses.HELD:
            found[int(g.text[k])] = family
    assert found == {0: "mit", 1: "cc-by-sa", 5: "gpl-3.0"}


def test_mix_of_unknown_and_empty_sources(spark, frame):
    rows = [(1, "a b c", "x"), (2, "a b", None), (3, None, "y"), (4, "", "y"), (4, "", "y"), (5, "a " * 100, "z")]
    found = mixing.mixed(frame("doc_id BIGINT, text STRING, source STRING", *rows))
    by = {r["source"]: r for r in found.collect()}
    assert found.count() == 6
    assert by["y"]["target"] == 0 and by["y"]["taken"] == 0
    # order x, y, z, null: weights 5, 2, 1, 5; x and null stop at twice their size, z takes the rest
    assert by["x"]["target"] == 6 and by[None]["target"] == 4 and by["z"]["target"] == pytest.approx(1.5 * 105 - 10)
    assert by["x"]["taken"] == 6 and by[None]["taken"] == 4
    assert by["z"]["rate"] == pytest.approx(1.475)


def test_newton_finds_the_tilt(spark, frame):
    rows = frame("source STRING, source_size BIGINT, n_docs BIGINT, target DOUBLE", ("a", 10, 1, 0.001), ("b", 10, 1, 20.0), ("c", 7, 1, 5.0))
    rate = {r["source"]: r["rate"] for r in mixing.balanced(rows).collect()}
    assert rate == pytest.approx({"a": 0.0001, "b": 2.0, "c": 5 / 7})
