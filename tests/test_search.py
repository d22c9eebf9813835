"""Search by a table of terms."""

from __future__ import annotations

import random

from saleroom.operators import listings, search

POST = "id BIGINT, title STRING, category STRING, description STRING, hide BOOLEAN, is_deleted BOOLEAN, created_at TIMESTAMP_NTZ"
AT = "2024-01-01 00:00:00"


def posts(frame, *texts):
    return frame(POST, *[(k, *t, False, False, AT) for k, t in enumerate(texts)])


def test_terms_of_every_kind(frame):
    rows = posts(
        frame, ("Silver Ring", "rings", None), ("ri", "ng", "r i n g"), (None, None, None), ("", "", ""), ("100% _cotton_", "a", "ÄÖ"),
        ("band of gold", "RING-box", "x"), ("Ring", None, "hidden"),
    )
    hidden = rows.withColumn("hide", rows["id"] == 6)
    terms = ["ring", "RING", "r", "ri", "r%ng", "ri_", "%", "_", "", "100\\%", "äö", "zzz", "ring%ring", "er ri", None, "ring", "_cotton"]
    found = search.search_table(hidden, frame("term STRING", *[(t,) for t in terms]))
    wanted = set()
    for t in {t for t in terms if t is not None}:
        wanted |= {(t, r["id"]) for r in listings.search(hidden, t).collect()}
    assert sorted((r["term"], r["id"]) for r in found.collect()) == sorted(wanted) and len(wanted) > 15


def test_random_terms(frame):
    draw = random.Random(9)
    word = lambda n: "".join(draw.choices("abC d", k=n))
    rows = posts(frame, *[(word(12), word(5), word(20)) for _ in range(60)])
    terms = [word(draw.randint(0, 5)) + draw.choice(["", "%", "_"]) + word(draw.randint(0, 3)) for _ in range(80)]
    wanted = {(t, r["id"]) for t in set(terms) for r in rows.where(listings.matches(f"%{t}%")).select("id").collect()}
    found = [(r["term"], r["id"]) for r in search.search_table(rows, frame("term STRING", *[(t,) for t in terms])).collect()]
    assert sorted(found) == sorted(wanted)


def test_plan_does_not_grow_with_the_terms(spark, frame):
    rows = posts(frame, ("a", "b", "c"))
    plans = []
    for n in (3, 3000):
        terms = spark.range(n).selectExpr("concat('term ', id) AS term")
        plan = search.search_table(rows, terms)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        plans.append(plan.count("\n"))
    assert plans[0] == plans[1]


def test_listings_are_not_broadcast(spark, frame, tmp_path):
    """However small their files look, they are joined by their ids in place."""
    posts(frame, ("a", "b", "c")).write.parquet(str(tmp_path / "posts"))
    rows = spark.read.parquet(str(tmp_path / "posts"))
    found = search.search_table(rows, frame("term STRING", ("a",)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" not in plan and "SortMergeJoin [id" in plan
