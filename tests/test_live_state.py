"""Live inbox per participant, intake of records, state that goes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from saleroom.operators import messaging
from saleroom.operators.quality import bid_rules
from saleroom.session import configure
from saleroom.streaming import intake, mail, seats
from saleroom.streaming.runner import replay, replay_updates
from tests.conftest import tuples
from tests.test_streaming import MESSAGE, at, stream  # noqa: F401


def test_participants_follow_the_inbox_over_three_batches(stream, frame):  # noqa: F811
    batches = [
        [(1, 7, 5, at(1), False, False), (2, 7, 1, at(2), False, True), (3, 8, 6, at(3), True, False)],
        [(4, 7, 9, at(9), False, False), (5, 8, None, at(4), False, False), (6, 9, 1, at(5), None, True)],
        [(7, 7, 5, at(4), False, False), (8, 8, 6, at(10), False, False)],
    ]
    reads = [[], [(1, 7)], [(4, 7)]]
    live = seats.live_seats(stream(MESSAGE, *batches), stream("id BIGINT, conversation_id BIGINT", *reads))
    got = replay_updates(live, ["conversation_id", "user_id"], "t")
    done = [i for r in reads for i, _ in r]
    everything = frame(MESSAGE, *[r for b in batches for r in b]).withColumn("is_read", F.when(F.col("id").isin(done), True).otherwise(F.col("is_read")))
    people = frame("id BIGINT, email STRING", *[(u, f"{u}@x") for u in (1, 5, 6, 9)])
    faces = frame("user_id BIGINT, first_name STRING, last_name STRING")
    columns = ["conversation_id", "user_id", "last_message_at", "message_count", "unread_count"]
    assert tuples(got, *columns) == tuples(messaging.inbox_summary(everything, people, faces), *columns)
    assert tuples(got, *columns)[0][:2] == (7, 1) and len(tuples(got, *columns)) == 5


def test_mail_state_holds_the_last_cooldown_only(spark, frame, tmp_path):
    configure(spark)
    out, arrival = str(tmp_path), "user_id BIGINT, sent_at TIMESTAMP_NTZ"
    batches = [[(u, at(u)) for u in range(20)], [(99, at(9000))], [(3, at(9100)), (98, at(20_000))]]
    left = []
    for rows in batches:
        frame(arrival, *rows).coalesce(1).write.mode("append").parquet(f"{out}/in")
        job = mail.throttle_mail(spark.readStream.schema(arrival).parquet(f"{out}/in"))
        job.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{out}/cp").option("stateVarName", "last").load()
        left.append({r[0] for r in state.select("key.user_id").collect()})
    assert left == [set(range(20)), {99}, {98}]
    # user 3's second mail comes after the cooldown; nothing else changes
    assert spark.read.parquet(f"{out}/rows").count() == 23


def test_records_are_kept_or_quarantined(spark, tmp_path):
    configure(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"id":1,"auction_id":2,"user_id":3,"bid_amount":4}', "{bad", '{"id":"x","auction_id":1}', '{"id":5,"user_id":1,"bid_amount":0}', "{}", '{"id":6,"auction_id":2,"user_id":3,"bid_amount":4,"more":1}']
    for k, line in enumerate(lines):
        (folder / f"{k}.json").write_text(line + "\n")
    stream = intake.judged(intake.read_records(spark, str(folder), "bids", 60), bid_rules())
    got = replay(stream, "t")
    assert tuples(got.where("accepted"), "id", "bid_amount") == [(1, 4), (6, 4)]
    assert tuples(got.where("record IS NOT NULL"), "id", "record", "failed") == [
        (None, '{"id":"x","auction_id":1}', [intake.MALFORMED]), (None, "{bad", [intake.MALFORMED])
    ]
    assert sorted(len(r["failed"]) for r in got.where("record IS NULL AND NOT accepted").collect()) == [2, 3]
    assert dt.datetime.now() and got.count() == 6
