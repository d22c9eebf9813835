"""Limiter windows that begin at a key's first hit: batch against a plain loop, stream in order of arrival."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from saleroom.session import scratch_path
from saleroom.streaming import windows
from saleroom.streaming.runner import replay_deliveries

START = dt.datetime(2024, 5, 1)
HITS = "key STRING, ts TIMESTAMP_NTZ"


def plain(hits: list[tuple[str | None, dt.datetime]], seconds: int) -> dict:
    found, opened = {}, {}
    for key, ts in sorted((h for h in hits if h[1] is not None), key=lambda h: h[1]):
        if key not in opened or ts >= opened[key] + dt.timedelta(seconds=seconds):
            opened[key] = ts
        found[key, opened[key]] = found.get((key, opened[key]), 0) + 1
    return found


def at(second: float) -> dt.datetime:
    return START + dt.timedelta(seconds=second)


@pytest.mark.parametrize("seed", range(3))
def test_windows_over_many_parts(spark, seed):
    rng = random.Random(seed)
    # two thirds of all hits have one key; some times repeat; a hit may lie at a window's very end
    keys = ["no-email"] * 12 + ["a", "b", "c", None, "", "d"]
    hits = [(rng.choice(keys), at(rng.choice([rng.randrange(0, 4000, 10), rng.random() * 4000]))) for _ in range(1500)]
    hits += [("a", None), (None, None)]
    rows = spark.createDataFrame(hits, HITS).repartition(7)
    for seconds in (10, 60, 5000):
        found = windows.hits_since_first(rows, F.col("key"), seconds).collect()
        assert {(r["key"], r["window_start"]): r["hits"] for r in found} == plain(hits, seconds)
        assert len(found) == len(plain(hits, seconds))


def test_no_hits_and_one_hit(spark):
    none = spark.createDataFrame([], HITS)
    assert windows.hits_since_first(none, F.col("key"), 60).collect() == []
    one = windows.hits_since_first(spark.createDataFrame([("a", at(0))], HITS), F.col("key"), 60).collect()
    assert [tuple(r) for r in one] == [("a", START, 1)]


def live(spark, batches, seconds):
    deliveries = [spark.createDataFrame(b, HITS).repartition(2) for b in batches]
    rows = replay_deliveries(deliveries, lambda h: windows.live_hits_since_first(h, F.col("key"), seconds), "hits-test")
    last = rows.groupBy("key", "window_start").agg(F.max("hits").alias("hits")).collect()
    return {(r["key"], r["window_start"]): r["hits"] for r in last}


def test_stream_over_deliveries(spark):
    rng = random.Random(9)
    hits = sorted(((rng.choice("aaab"), at(rng.randrange(0, 900, 5))) for _ in range(200)), key=lambda h: h[1])
    cuts = [0, 60, 61, 150, 200]
    batches = [hits[a:b] for a, b in zip(cuts, cuts[1:])]
    for b in batches:
        rng.shuffle(b)
    assert live(spark, batches, 60) == plain(hits, 60)


def test_late_hit_counts_in_the_open_window(spark):
    batches = [[("a", at(0))], [("a", at(100))], [("a", at(30)), ("a", at(120))], [("a", at(160))]]
    assert live(spark, batches, 60) == {("a", at(0)): 1, ("a", at(100)): 3, ("a", at(160)): 1}


def test_state_ends_with_the_window(spark):
    path = scratch_path(spark, "hits-state")
    for k, rows in enumerate(([("old", at(0))], [("new", at(7200))], [("new", at(7210))])):
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = windows.live_hits_since_first(spark.readStream.schema(HITS).parquet(f"{path}/in"), F.col("key"), 60)
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{path}/checkpoint")
    assert [r["key"]["key"] for r in state.select("key").collect()] == ["new"]
