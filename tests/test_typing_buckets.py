"""Typing bursts of many writers share few state rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from saleroom.session import configure
from saleroom.streaming import windows
from tests.conftest import tuples

TYPING = "id BIGINT, conversation_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, is_stop BOOLEAN"
START = dt.datetime(2024, 1, 1)


def replayed(spark, frame, folder, batches, buckets):
    """All finished bursts; one batch after the other, from the checkpoint."""
    configure(spark)
    for rows in batches:
        shown = [(*r[:3], str(START + dt.timedelta(seconds=r[3])), r[4]) for r in rows]
        frame(TYPING, *shown).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        found = windows.typing_sessions(spark.readStream.schema(TYPING).parquet(f"{folder}/in"), 10, buckets=buckets)
        found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")


def one_by_one(batches, gap=10):
    """Bursts as (conversation, user, first, last, events, end), an event at a time."""
    held, done = {}, []
    for rows in batches:
        for _, talk, user, t, stop in sorted(rows, key=lambda r: (r[3], r[0])):
            key = talk, user
            if key in held and t - held[key][1] > gap:
                done.append((*key, *held.pop(key), "idle"))
            first, last, n = held.pop(key, (t, t, 0))
            held[key] = first, max(last, t), n + 1
            if stop:
                done.append((*key, *held.pop(key), "stop"))
    mark = max(r[3] for rows in batches for r in rows) - 600
    return done + [(*key, *b, "idle") for key, b in held.items() if b[1] + gap < mark]


def test_many_writers_share_buckets(spark, frame, tmp_path):
    draw = random.Random(3)
    times = sorted(draw.randint(0, 400) for _ in range(600))
    users = [None, *range(60)]
    rows = [(i, draw.choice([None, 0, 2**60 + 1]), draw.choice(users), t, draw.random() < 0.1) for i, t in enumerate(times)]
    batches = [rows[:200], rows[200:400], [*rows[400:], (900, 5, 5, 2000, False)]]
    got = replayed(spark, frame, str(tmp_path), batches, 4)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) - int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    shown = got.withColumns({"started_at": seconds("started_at"), "last_event_at": seconds("last_event_at")})
    assert tuples(shown, "conversation_id", "user_id", "started_at", "last_event_at", "n_events", "ended_by") == sorted(one_by_one(batches), key=str)
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/cp")
    assert held.count() == 1  # the last event's bucket; all other bursts are over and gone
    assert held.select(F.size("value.user_id")).first()[0] == 1


def test_state_rows_are_no_more_than_the_buckets(spark, frame, tmp_path):
    rows = [(i, 1, i, 0, False) for i in range(80)]
    assert replayed(spark, frame, str(tmp_path), [rows], 4).count() == 0
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/cp")
    assert held.count() <= 4 and held.select(F.sum(F.size("value.user_id"))).first()[0] == 80
