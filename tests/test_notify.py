from __future__ import annotations

import datetime as dt
import random

import pytest

from saleroom.operators import notify, quality
from saleroom.plans import changes
from tests.conftest import tuples

NOW = "2024-01-10 12:00:00"
PROFILE = (
    "user_id BIGINT, send_email_notifications BOOLEAN, last_auction_email_at TIMESTAMP_NTZ, "
    "last_message_email_at TIMESTAMP_NTZ"
)


@pytest.fixture
def profiles(frame):
    return frame(
        PROFILE,
        (1, True, None, "2024-01-10 11:59:00"),
        (2, True, "2024-01-10 11:00:00", "2024-01-10 11:40:01"),
        (3, True, "2024-01-10 09:00:00", "2024-01-10 11:40:00"),
        (4, False, None, None),
        (5, True, "2024-01-10 10:00:00", None),
    )


@pytest.fixture
def people(frame):
    return frame("id BIGINT, email STRING", *[(i, f"u{i}@x") for i in range(1, 7)])


def test_cooldown_is_strict(profiles, people):
    got = notify.item_mail_recipients(profiles, people, NOW)
    # 60 minutes: no, 180 minutes: yes, exactly 120 minutes: no
    assert tuples(got, "user_id") == [(1,), (3,)]


def test_message_mail_reasons(profiles, frame):
    messages = frame("id BIGINT, user_id BIGINT", *[(i, i) for i in range(1, 7)])
    got = notify.message_mail_decision(messages, profiles, NOW, admin_id=1)
    assert tuples(got, "user_id", "reason") == [
        (1, "send"), (2, "throttled"), (3, "send"), (4, "opted-out"), (5, "send"), (6, "opted-out")
    ]
    # the admin must be opted in as well
    got = notify.message_mail_decision(messages, profiles, NOW, admin_id=4)
    assert {r.user_id: r.reason for r in got.collect()}[4] == "opted-out"


def test_failed_mails_do_not_move_the_time(profiles, frame):
    outcomes = frame("user_id BIGINT, sent BOOLEAN", (1, True), (3, False), (5, None))
    got = changes.touch_mail_times(profiles, outcomes, NOW)
    times = {r.user_id: str(r.last_auction_email_at) for r in got.collect()}
    assert times[1] == NOW and times[3] == "2024-01-10 09:00:00" and times[4] == "None"
    assert tuples(notify.delivery_totals(outcomes), "total", "sent", "failed") == [(3, 1, 2)]


def at(minutes: float) -> str:
    return str(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes))


ARRIVAL = "user_id BIGINT, sent_at TIMESTAMP_NTZ"


def test_eleven_items_give_one_mail_per_user(frame):
    rows = [(u, at(i)) for u in (1, 2) for i in range(11)]
    got = notify.mail_after_cooldown(frame(ARRIVAL, *rows))
    assert [(u, str(t)) for u, t in tuples(got, "user_id", "sent_at")] == [(1, at(0)), (2, at(0))]


def test_earlier_mails_count(frame):
    rows = frame(ARRIVAL, (1, at(60)), (1, at(121)), (2, at(60)))
    last = frame("user_id BIGINT, last TIMESTAMP_NTZ", (1, at(0)))
    got = notify.mail_after_cooldown(rows, last_mails=last)
    assert [(u, str(t)) for u, t in tuples(got, "user_id", "sent_at")] == [(1, at(121)), (2, at(60))]


def greedy(times, gap=120):
    sent = []
    for t in sorted(set(times)):
        if not sent or t - sent[-1] > gap:
            sent.append(t)
    return sent


def test_users_over_several_parts_are_exact(spark, frame):
    rng = random.Random(7)
    users = {
        1: [rng.randint(0, 1500) for _ in range(200)],
        2: [0, 120, 121, 240, 241, 242, 1000],
        3: [5],
        4: [rng.randint(0, 1500) + rng.random() for _ in range(60)],
        None: [3, 4, 500],
    }
    rows = frame(ARRIVAL, *[(u, at(t)) for u, ts in users.items() for t in ts])
    wanted = {(u, at(t)[:23]) for u, ts in users.items() for t in greedy(ts)}
    for adaptive, parts in (("true", "4"), ("false", "13")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = notify.mail_after_cooldown(rows).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {(r.user_id, str(r.sent_at)[:23]) for r in got} == wanted and len(got) == len(wanted)


def test_retention_is_strict(frame):
    rows = frame("id BIGINT, created_at TIMESTAMP_NTZ", (1, "2023-12-11 12:00:00"), (2, "2023-12-11 11:59:59"), (3, NOW))
    assert tuples(changes.purge_notifications(rows, NOW), "id") == [(1,), (3,)]


def test_broadcast_texts(profiles, people):
    rows = notify.broadcast_outbox(notify.opted_in(profiles, people), " Hi <all> ", "one\n<two> & ")
    assert rows.count() == 4
    row = rows.first()
    assert (row.subject, row.subject_html, row.body_html) == ("Hi <all>", "Hi &lt;all&gt;", "one<br />&lt;two&gt; &amp;")
    with pytest.raises(ValueError):
        notify.broadcast_outbox(rows, " ", "text")


def test_item_mail_shows_the_newest_item(profiles, people, frame):
    lots = frame("id BIGINT, title STRING, description STRING, image_urls ARRAY<STRING>", (1, "old", "d", ["a"]), (2, None, None, []))
    row = notify.auction_outbox(notify.opted_in(profiles, people), lots, site="https://s").first()
    assert (row.title, row.image_url, row.item_url) == ("", "", "https://s/auctions/2")


def test_an_empty_message_gets_a_stand_in(people, frame):
    decided = frame("id BIGINT, recipient_id BIGINT, message_content STRING, reason STRING", (1, 1, "", "send"), (2, 2, "x", "throttled"))
    assert tuples(notify.message_outbox(decided, people), "message_id", "preview_html") == [(1, notify.EMPTY_PREVIEW)]


def test_badges_and_unread(frame):
    notes = frame("id BIGINT, user_id BIGINT, is_read BOOLEAN, created_at TIMESTAMP_NTZ", (1, 1, False, at(1)), (2, 1, False, at(2)), (3, 2, True, at(3)))
    talk = frame("user_id BIGINT, is_read BOOLEAN, is_from_admin BOOLEAN", (1, False, False), (3, False, False), (3, None, False), (4, False, True))
    assert tuples(notify.unread_badges(notes, talk), "user_id", "unread_notifications", "unread_messages") == [(1, 2, 1), (3, 0, 1)]
    assert [str(r.created_at) for r in notify.unread(notes).collect()] == [at(2), at(1)]


def test_checks_name_every_broken_rule(frame):
    bids = frame("id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT", (1, 1, 1, 1), (2, None, 0, None), (3, 1, 1, 0))
    good, bad = quality.split(quality.check(bids, quality.bid_rules()))
    assert tuples(good, "id") == [(1,)]
    assert {r.id: list(r.failed) for r in bad.collect()} == {
        2: ["auction_id is required", "user_id is required", "bid_amount is required"], 3: ["bid_amount is required"]
    }
    texts = frame("id STRING, subject STRING, message STRING, is_paid STRING, tracking_number STRING, message_content STRING",
                  ("12", "s", "m", "true", "T", "x"), ("1x", " ", None, "yes", "", ""))
    rules = {**quality.id_rules(), **quality.broadcast_rules(), **quality.paid_rules(), **quality.tracking_rules(), **quality.message_rules()}
    assert [len(r.failed) for r in quality.check(texts, rules).collect()] == [0, 6]


def test_recent_errors_are_the_newest(frame):
    log = frame("id BIGINT, created_at TIMESTAMP_NTZ, error STRING, context STRING", *[(i, at(i), f"e{i}", None) for i in range(5)])
    assert [r.id for r in quality.recent_errors(log, 3).collect()] == [4, 3, 2]
