"""Live jobs over several micro-batches, one file each."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from saleroom.operators import auctions, messaging, notify
from saleroom.streaming import bids as live_bids
from saleroom.streaming import closing, fanout, inbox, mail, routing, windows
from saleroom.streaming.runner import replay, replay_updates
from tests.conftest import tuples

BID = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ"
START = dt.datetime(2024, 1, 1)


def at(seconds: float) -> str:
    return str(START + dt.timedelta(seconds=seconds))


@pytest.fixture
def stream(spark, frame, tmp_path):
    """Writes each list of rows as one file and reads them back one file per micro-batch."""

    def build(ddl, *batches):
        folder = str(tmp_path / f"in-{uuid.uuid4().hex}")
        schema = None
        for i, rows in enumerate(batches):
            df = frame(ddl, *rows).coalesce(1)
            schema = df.schema
            df.write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def test_bids_are_judged_across_batches(stream, frame):
    rng = random.Random(11)
    rows = [(i, rng.randint(1, 3), rng.randint(1, 4), rng.randint(1, 300), at(i)) for i in range(120)]
    got = replay(live_bids.accept_bids(stream(BID, rows[:50], rows[50:51], rows[51:])), "t")
    ledger = auctions.bid_ledger(frame(BID, *rows)).where("accepted")
    loser = F.when(F.col("prior_user_id") != F.col("user_id"), F.col("prior_user_id"))
    want = ledger.withColumn("outbid_user_id", loser)
    assert tuples(got, "id", "bid_amount", "outbid_user_id") == tuples(want, "id", "bid_amount", "outbid_user_id")


def test_a_late_bid_is_judged_by_the_state(stream):
    got = replay(live_bids.accept_bids(stream(BID, [(1, 1, 5, 100, at(50))], [(2, 1, 6, 90, at(10)), (3, 1, 6, 110, at(20))])), "t")
    assert tuples(got, "id", "outbid_user_id") == [(1, None), (3, 5)]


def test_auctions_close_extend_and_reject(stream, frame):
    lots = frame("id BIGINT, end_time TIMESTAMP_NTZ, is_active BOOLEAN",
                 (1, at(1000), True), (2, at(1000), True), (3, at(1000), True), (4, at(99999), True), (5, at(1), False))
    first = [(1, 1, 5, 10, at(0)), (2, 1, 6, 30, at(970)), (3, 2, 5, 10, at(500)), (4, 9, 5, 10, at(600)), (5, 4, 5, 10, at(600))]
    second = [(6, 1, 7, 20, at(1290)), (7, 1, 7, 90, at(1600)), (8, 2, 7, 99, at(1000)), (9, 5, 5, 5, at(900))]
    third = [(10, 4, 6, 5, at(9000))]
    fourth = [(11, 1, 8, 500, at(9001)), (12, 4, 6, 50, at(9100))]
    out = replay(closing.close_auctions(stream(BID, first, second, third, fourth), lots), "t")
    results = out.where("kind = 'result'")
    # 1: extended at 970 and 1290, so 1600 is too late only if the end is 1600
    assert [(a, e, str(t), u, b) for a, e, t, u, b in tuples(results, "auction_id", "extensions", "end_time", "user_id", "bid_amount")] == [
        (1, 2, at(1600), 6, 30), (2, 0, at(1000), 5, 10), (3, 0, at(1000), None, None)
    ]
    dead = out.where("kind = 'dead-letter'")
    assert tuples(dead, "bid_id", "reason") == [
        (11, "after the end"), (4, "unknown auction"), (7, "after the end"), (8, "after the end"), (9, "unknown auction")
    ]


def test_auctions_open_and_are_cancelled_while_the_stream_runs(stream, frame):
    lots = frame("id BIGINT, end_time TIMESTAMP_NTZ, is_active BOOLEAN", (1, at(1000), True), (2, at(1000), True))
    placed = stream(
        BID, [(1, 1, 5, 10, at(0)), (2, 7, 5, 10, at(10))], [(3, 7, 6, 20, at(400)), (4, 2, 6, 20, at(400))],
        [(5, 2, 8, 30, at(700)), (6, 9, 8, 30, at(3000))], [(7, 9, 8, 30, at(5000))],
    )
    opened = stream("id BIGINT, end_time TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ", [(7, at(900), at(1))], [(7, at(2000), at(2))])
    gone = stream("auction_id BIGINT, cancelled_at TIMESTAMP_NTZ", [], [(2, at(600))])
    out = replay(closing.close_auctions(placed, lots, openings=opened, cancellations=gone), "t")
    assert tuples(out.where("kind = 'result'"), "auction_id", "user_id", "bid_amount") == [(1, 5, 10), (7, 6, 20)]
    assert tuples(out.where("kind = 'dead-letter'"), "bid_id", "reason") == [
        (5, "after the end"), (6, "unknown auction"), (7, "unknown auction")
    ]


ARRIVAL = "user_id BIGINT, sent_at TIMESTAMP_NTZ"


def test_mail_gate_keeps_its_state(stream, frame):
    rng = random.Random(2)
    times = sorted(rng.randint(0, 40000) for _ in range(90))
    rows = [(1 + i % 2, at(t)) for i, t in enumerate(times)]
    got = replay(mail.throttle_mail(stream(ARRIVAL, rows[:30], rows[30:60], rows[60:])), "t")
    want = notify.mail_after_cooldown(frame(ARRIVAL, *rows))
    assert tuples(got, "user_id", "sent_at") == tuples(want, "user_id", "sent_at")


def test_mail_gate_for_messages(stream):
    rows = [(1, at(0)), (1, at(60)), (2, at(0)), (2, at(1200)), (2, at(1300))]
    got = replay(mail.throttle_mail(stream(ARRIVAL, rows), 20, exempt_user=1, inclusive=True), "t")
    assert [(u, str(t)) for u, t in tuples(got, "user_id", "sent_at")] == [
        (1, at(0)), (1, at(60)), (2, at(0)), (2, at(1200))
    ]


MESSAGE = "id BIGINT, conversation_id BIGINT, user_id BIGINT, sent_at TIMESTAMP_NTZ, is_read BOOLEAN, is_from_admin BOOLEAN"


def test_inbox_keeps_the_last_version(stream):
    got = replay_updates(
        inbox.live_inbox(stream(MESSAGE, [(1, 7, 5, at(1), False, False)], [(2, 7, 5, at(2), False, False), (3, 8, 6, at(3), True, False)])),
        ["conversation_id"], "t",
    )
    assert tuples(got, "conversation_id", "message_count", "unread_count") == [(7, 2, 2), (8, 1, 0)]


def test_reading_lowers_the_unread_count(stream):
    talk = stream(MESSAGE, [(1, 7, 5, at(1), False, False), (2, 7, 5, at(2), False, False)], [(3, 7, 1, at(3), False, True)])
    reads = stream("id BIGINT, conversation_id BIGINT", [], [(2, 7)])
    got = replay_updates(inbox.live_inbox(talk, reads), ["conversation_id"], "t")
    assert tuples(got, "conversation_id", "message_count", "unread_count") == [(7, 3, 1)]


CHANGE = "id BIGINT, key BIGINT, status STRING, changed_at TIMESTAMP_NTZ"


def test_latest_status_over_batches_with_repeats(stream, spark, frame, tmp_path):
    checkpoint = str(tmp_path / "cp")
    source = stream(CHANGE, [(1, 1, "a", at(10)), (2, 2, "x", at(1))], [(1, 1, "a", at(10)), (3, 1, "old", at(5))], [(4, 2, "y", at(20))])
    inbox.maintain_status(source, checkpoint).awaitTermination()
    assert tuples(inbox.read_status(spark, checkpoint), "key", "status", "id") == [(1, "a", 1), (2, "y", 4)]
    assert tuples(inbox.read_status(spark, checkpoint, 0), "key", "status") == [(1, "a"), (2, "x")]
    # started again without anything new, the job changes nothing
    inbox.maintain_status(source, checkpoint).awaitTermination()
    assert tuples(inbox.read_status(spark, checkpoint), "key", "status") == [(1, "a"), (2, "y")]


def test_rate_limit_windows(stream):
    rows = [(i, at(60 * i), "A@x" if i % 2 else "a@X") for i in range(6)] + [(9, at(3599), None), (10, at(3600), "a@x")]
    events = stream("id BIGINT, ts TIMESTAMP_NTZ, email STRING", rows[:4], rows[4:])
    hits = windows.hits_per_window(events, windows.email_key(F.col("email")), "1 hour")
    got = windows.over_limit(replay_updates(hits, ["key", "window_start"], "t"), 3)
    assert [(k, str(w), n, e) for k, w, n, e in tuples(got, "key", "window_start", "hits", "excess")] == [("a@x", at(0), 6, 3)]


def test_fanout_of_every_event_kind(frame):
    rows = [
        (1, "auction-created", 5, None, False), (2, "user-won", 5, None, False), (3, "sale-paid", 5, None, False),
        (4, "sale-paid", None, None, False), (5, "sale-created", 0, None, False), (6, "new_message", 5, 7, True),
        (7, "message_notify", 5, 7, True), (8, "new_customer_message", 5, 7, False), (9, "new_customer_message", 5, 7, True),
        (10, "user-outbid", None, None, False), (11, "unheard-of", 5, 7, False),
    ]
    events = frame("id BIGINT, event_name STRING, user_id BIGINT, conversation_id BIGINT, is_from_admin BOOLEAN", *rows)
    assert tuples(fanout.fan_out(events), "id", "target") == sorted([
        (1, "everyone"), (2, "user_5"), (3, "admin_room"), (3, "user_5"), (6, "conversation_7"), (7, "user_5"), (8, "admin_room"),
    ], key=str)


def test_fanout_and_routing_run_on_streams(stream, frame):
    events = stream("id BIGINT, event_name STRING, user_id BIGINT, conversation_id BIGINT, is_from_admin BOOLEAN",
                    [(1, "sale-paid", 5, None, False)])
    assert tuples(replay(fanout.fan_out(events).select("id", "target"), "t"), "target") == [("admin_room",), ("user_5",)]
    past = frame(MESSAGE, (1, 7, 5, at(0), False, False))
    live = stream(MESSAGE, [(2, 7, 1, at(1), False, True)], [(3, 7, 5, at(2), False, False)])
    got = replay(messaging.route(live, messaging.reply_recipient(past), 1).select("id", "recipient_id"), "t")
    assert tuples(got, "id", "recipient_id") == [(2, 5), (3, 1)]


TYPING = "id BIGINT, conversation_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ, is_stop BOOLEAN"


def test_typing_bursts_cross_batches(stream):
    first = [(1, 4, 1, at(0), False), (2, 4, 1, at(0.5), False), (3, 4, 2, at(0), False), (4, 4, 2, at(0.4), True), (5, 4, 2, at(0.6), False)]
    second = [(6, 4, 1, at(1.2), False), (7, 4, 1, at(9), False), (8, 4, 2, at(1.6), True)]
    third = [(9, 4, 3, at(5000), False)]
    got = replay(windows.typing_sessions(stream(TYPING, first, second, third), 1), "t")
    assert [(u, str(a), str(b), n, e) for u, a, b, n, e in tuples(got, "user_id", "started_at", "last_event_at", "n_events", "ended_by")] == [
        (1, at(0), at(1.2), 3, "idle"), (1, at(9), at(9), 1, "idle"),
        (2, at(0), at(0.4), 2, "stop"), (2, at(0.6), at(1.6), 2, "stop"),
    ]


def test_typing_in_two_conversations_is_two_bursts(stream):
    rows = [(1, 4, 1, at(0), False), (2, 5, 1, at(0.5), True), (3, 4, 1, at(0.8), True)]
    got = replay(windows.typing_sessions(stream(TYPING, rows), 1), "t")
    assert tuples(got, "conversation_id", "user_id", "n_events") == [(4, 1, 2), (5, 1, 1)]


def test_an_answer_goes_to_the_customer_of_an_earlier_batch(stream, frame):
    past = frame(MESSAGE, (1, 7, 5, at(0), False, False))
    live = stream(
        MESSAGE,
        [(2, 7, 1, at(1), False, True), (3, 8, 6, at(2), False, False), (4, 9, 1, at(3), False, True)],
        [(5, 8, 1, at(4), False, True), (6, 9, 7, at(5), False, False), (7, 9, 1, at(6), False, True), (8, 9, 2, at(7), False, False)],
    )
    got = replay(routing.route_live(live, past, 1), "t")
    assert tuples(got, "id", "recipient_id") == [(2, 5), (3, 1), (4, 1), (5, 6), (6, 1), (7, 7), (8, 1)]


PURCHASES = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ, is_buy_now BOOLEAN"


def test_a_buy_now_below_the_highest_bid_counts_live(stream):
    first = [(1, 1, 7, 100, at(1), False), (2, 1, 8, 80, at(2), True), (3, 1, 9, 90, at(3), False)]
    second = [(4, 1, 6, 70, at(4), True), (5, 1, 5, 120, at(5), None)]
    got = replay(live_bids.accept_bids(stream(PURCHASES, first, second)), "t")
    assert tuples(got, "id", "is_buy_now", "outbid_user_id") == [(1, False, None), (2, True, 7), (4, True, 7), (5, False, 7)]
