"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saleroom.llm import language, leaks, licenses, lines, mixing, pages, quality, repeats, rules, simhash

# Names that the operators use for columns of their own.
CLASHES = ("row", "part", "bucket", "node", "vertex", "_text", "_words", "_gone", "_leaky", "_keep_0", "n_lines", "n_words", "size", "score", "fp", "key", "_id", "_h")
LONG = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}word" for k in range(60_000))
PROSE = "the small house near the river was sold to a family with three children last spring"
ROWS = [
    (1, PROSE, "en", "a", 1), (1, PROSE, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, LONG, "en", "b", 9),
    (None, "no id here", "en", None, 3), (5, " \n\t \n", "en", "a", 2), (6, "one", "en", "a", 1), (7, "ÀÉ ß 漢字   x", "en", "c", 1),
]
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def docs(spark, frame):
    return frame(DOCS, *ROWS).select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.fixture
def none(docs):
    return docs.limit(0)


def model(texts=()):
    return language.trained([PROSE, "das kleine haus am fluss wurde verkauft"] * 20, ["en", "de"] * 20)


def items(frame, *rows):
    return frame("item_id BIGINT, text STRING", *rows)


def operators(spark, frame):
    bench = items(frame, (1, PROSE), (2, None), (3, ""), (4, "two words"))
    lang = model()
    licence = licenses.trained([PROSE])
    labels = frame("doc_id BIGINT, quality INT, toxic INT", (1, 1, 0), (6, 0, 0), (None, 1, 0), (3, None, 0))

    def scored(d):
        context = quality.context_table(d)
        return quality.scored(d, context, quality.learned(d, labels, context))

    return {
        "rules": rules.quality_rules,
        "leaks": lambda d: leaks.leaks(d, bench),
        "clean": lambda d: leaks.decontaminated(d, bench),
        "quality": scored,
        "repeats": repeats.without_repeats,
        "language": lambda d: language.identified(d, lang),
        "accepted": lambda d: language.accepted(d, lang),
        "lines": lambda d: lines.without_templates(d, counts=False),
        "licences": lambda d: licenses.licences(d, licence),
        "simhash": simhash.classes,
        "simhash rows": simhash.one_of_each,
        "mixing": mixing.mixed,
    }


# Rows that come out of ROWS: one per row, but for what the operator is there to take away.
COUNTS = {
    "rules": 9, "leaks": 1, "clean": 7, "quality": 9, "repeats": 9, "language": 9, "accepted": None, "lines": 9, "licences": 0,
    "simhash": 9, "simhash rows": 7, "mixing": 9,
}


@pytest.mark.parametrize("name", list(COUNTS))
def test_odd_rows(spark, frame, docs, name):
    found = operators(spark, frame)[name](docs).collect()
    if COUNTS[name] is not None:
        assert len(found) == COUNTS[name]
    if name in ("clean", "accepted", "lines", "simhash rows"):
        assert found[0].__fields__ == docs.columns


@pytest.mark.parametrize("name", list(COUNTS))
def test_no_rows(spark, frame, none, name):
    assert operators(spark, frame)[name](none).collect() == []


def test_null_rows_have_defined_results(spark, frame, docs):
    made = operators(spark, frame)
    by = lambda name: {r["doc_id"]: r for r in made[name](docs).collect()}
    assert (by("rules")[2]["n_words"], by("rules")[2]["kept"], by("rules")[4]["n_words"]) == (0, False, 60_000)
    assert by("language")[2]["lang_pred"] == "und" and not by("language")[5]["accepted"]
    assert by("repeats")[2]["n_words"] == 0 and by("repeats")[None]["kept"] == "no id here"
    assert by("lines")[2]["text"] is None and by("lines")[3]["text"] == "" and by("lines")[5]["text"] == " \n\t \n"
    # null, empty and blank texts have fingerprint zero
    assert {by("simhash")[k]["component_id"] for k in (2, 3, 5)} == {2} and by("simhash")[5]["fp"] == 0
    assert by("mixing")[2]["size"] == 0
    assert all(0 <= r["score"] <= 1 for r in by("quality").values())


def test_pages_without_content(spark, frame):
    rows = [(1, None, None), (1, None, None), (2, "no url", ""), (None, "https://x.example/a", "<p>a</p>"), (3, "https://x.example", "<p>" + LONG + "</p>")]
    made = frame("page_id BIGINT, url STRING, html STRING", *rows).withColumn("host", F.lit(1)).withColumn("templates", F.lit(2))
    found = pages.main_text(made)
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in found.collect()) == [("1", 0), ("1", 0), ("2", 0), ("3", len(LONG)), ("None", 1)]
    assert pages.main_text(made.limit(0)).collect() == []


def test_models_without_labels(spark, frame, docs, none):
    nothing = frame("doc_id BIGINT, quality INT, toxic INT")
    context = quality.context_table(docs)
    found = quality.scored(docs, context, quality.learned(docs, nothing, context)).collect()
    assert {r["score"] for r in found} == {0.5}
    unknown = language.learned_from(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identified(docs, unknown).collect()} == {"und"}
    assert licenses.licences(none, licenses.learned(none)).collect() == []


@pytest.fixture
def folder(tmp_path, frame):
    items(frame, (1, PROSE), (2, None)).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_no_rows(spark, docs, none, folder, name, stage):
    for rows in (docs, none):
        found = stage(spark, rows, folder)
        if name != "mixing":
            assert found.columns == docs.columns
        found.collect()
    assert found.count() == 0
