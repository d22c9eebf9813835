from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleroom.functions import text
from saleroom.operators import messaging
from saleroom.plans import conversations
from tests.conftest import tuples

MESSAGE = (
    "id BIGINT, conversation_id BIGINT, user_id BIGINT, message_content STRING, sent_at TIMESTAMP_NTZ, "
    "is_read BOOLEAN, is_from_admin BOOLEAN"
)


@pytest.fixture
def talk(frame):
    return frame(
        MESSAGE,
        (1, 10, 5, "hello", "2024-01-01 00:00:01", False, False),
        (2, 10, 1, "hi", "2024-01-01 00:00:02", False, True),
        (3, 10, 5, "again", "2024-01-01 00:00:03", None, False),
        (4, 20, 6, "other", "2024-01-01 00:00:00", True, False),
        (5, 30, 5, "late", "2024-01-02 00:00:00", False, False),
        (6, 40, 1, "broadcast", "2024-01-02 00:00:00", False, True),
    )


def test_inbox_has_one_row_per_participant_even_without_profile(talk, frame):
    people = frame("id BIGINT, email STRING", (1, "admin@x"), (5, "five@x"), (6, "six@x"))
    faces = frame("user_id BIGINT, first_name STRING, last_name STRING", (5, "F", "Ive"))
    got = messaging.inbox_summary(talk, people, faces)
    assert tuples(got, "conversation_id", "user_id", "first_name", "message_count", "unread_count") == [
        (10, 1, None, 3, 1), (10, 5, "F", 3, 1), (20, 6, None, 1, 0), (30, 5, "F", 1, 1), (40, 1, None, 1, 0)
    ]
    assert got.first().last_message_at.day == 2


def test_first_conversation_and_reply_recipient(talk):
    assert tuples(messaging.first_conversation(talk), "user_id", "conversation_id") == [(1, 10), (5, 10), (6, 20)]
    assert tuples(messaging.reply_recipient(talk), "conversation_id", "recipient_id") == [(10, 5), (20, 6), (30, 5)]


def test_routing_falls_back_to_the_message_user(talk):
    routed = messaging.route(talk, messaging.reply_recipient(talk), 1)
    assert tuples(routed, "id", "recipient_id") == [(1, 1), (2, 5), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_threads_of_users_include_the_other_side(talk, frame):
    got = messaging.thread_messages(talk, frame("id BIGINT", (5,)))
    assert [r.id for r in got.collect()] == [5, 1, 2, 3]


def test_conversations_of_a_batch(talk, frame):
    new = frame(
        "id BIGINT, user_id BIGINT, sent_at TIMESTAMP_NTZ",
        (100, 5, "2024-02-01"), (101, 9, "2024-02-03"), (102, 8, "2024-02-02"), (103, 9, "2024-02-04"),
    )
    assert tuples(conversations.assign(new, talk), "id", "conversation_id") == [
        (100, 10), (101, 42), (102, 41), (103, 42)
    ]


def test_given_conversations_are_kept(talk, frame):
    new = frame(
        "id BIGINT, user_id BIGINT, conversation_id BIGINT, sent_at TIMESTAMP_NTZ",
        (100, 5, 77, "2024-02-01"), (101, 9, 123, "2024-02-03"), (102, 9, None, "2024-02-04"), (103, 8, 0, "2024-02-04"),
    )
    assert tuples(conversations.assign(new, talk), "id", "conversation_id") == [
        (100, 77), (101, 123), (102, 123), (103, 124)
    ]


def test_an_empty_table_starts_at_one(talk, frame):
    new = frame("id BIGINT, user_id BIGINT, sent_at TIMESTAMP_NTZ", (100, 5, "2024-02-01"))
    assert tuples(conversations.assign(new, talk.where("id < 0")), "conversation_id") == [(1,)]
    assert messaging.next_conversation_id(talk.where("id < 0")).first().next_id == 1


# Fixed value: a text sealed with AES-256-GCM under SHA-256('s3cret'), IV 000102…0b,
# stored as base64(IV | tag | ciphertext); made with an independent library call.
def _sealed(spark, plain: str, secret: str) -> str:
    row = spark.range(1).select(
        F.aes_encrypt(
            F.lit(plain).cast("binary"), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM"), F.lit("DEFAULT"),
            F.unhex(F.lit("000102030405060708090a0b")),
        ).alias("x")
    ).first()
    raw = bytes(row.x)
    import base64

    return base64.b64encode(raw[:12] + raw[-16:] + raw[12:-16]).decode()


def test_decryption_of_good_short_foreign_and_missing_values(spark, frame):
    good, foreign = _sealed(spark, "héllo\nyou", "s3cret"), _sealed(spark, "x", "other")
    rows = frame("id BIGINT, message_content STRING", (1, good), (2, foreign), (3, "AAAA"), (4, None), (5, "plain text!"), (6, ""))
    got = messaging.decrypt_messages(rows, "s3cret")
    assert tuples(got, "id", "message_content", "is_readable") == [
        (1, "héllo\nyou", True), (2, None, False), (3, None, False), (4, None, False), (5, None, False), (6, None, False)
    ]


def test_encryption_is_undone_and_repeatable(talk):
    stored = messaging.encrypt_messages(talk, "s3cret")
    again = messaging.encrypt_messages(talk, "s3cret")
    assert tuples(stored, "id", "message_content") == tuples(again, "id", "message_content")
    assert stored.select("message_content").distinct().count() == talk.count()
    assert tuples(messaging.decrypt_messages(stored, "s3cret"), "id", "message_content") == tuples(talk, "id", "message_content")


def one(frame, column, *values):
    rows = frame("i BIGINT, v STRING", *[(i, v) for i, v in enumerate(values)])
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_preview(frame):
    exact, long, spaced = "a" * 200, "a" * 201, "a" * 198 + "  " + "bcd"
    assert one(frame, text.preview, exact, long, spaced, None, "") == [
        exact, "a" * 200 + "…", "a" * 198 + "…", "", ""
    ]


def test_html(frame):
    assert one(frame, text.html_body, "a & b\r\n<c> \"d\" 'e'\rf\ng", "&amp;", None) == [
        "a &amp; b<br />&lt;c&gt; &quot;d&quot; &#39;e&#39;<br />f<br />g", "&amp;amp;", ""
    ]


def test_trimming_knows_unicode_spaces(frame):
    assert one(frame, text.trimmed, " ﻿ x y 　\n", "  ") == ["x y", ""]
    assert one(frame, text.is_blank, None, "", "  ", "x") == [True, True, True, False]


def test_urls(frame):
    assert one(frame, text.url_key, "http://h/a/b.jpg?x=1", "http://h", "http://h//a", "no url", None) == [
        "a/b.jpg", "", "/a", None, None
    ]
    assert one(frame, text.url_tail, "http://h/a/img1.jpg", "plain") == ["img1.jpg", "plain"]
    assert one(frame, text.percent_encoded, "a b+c/!'()~*ü") == ["a%20b%2Bc%2F!'()~*%C3%BC"]
    assert one(frame, text.tracking_link, "94 00") == [text.TRACKING_URL + "94%2000"]


def test_prices(frame):
    values = one(frame, text.price_number, "19.99", "ask", "100 usd", "", None, " -3.", ".5")
    assert [v if v is None else float(v) for v in values] == [19.99, None, 100.0, None, None, -3.0, 0.5]


def test_fill_uses_each_value_as_it_is(frame):
    rows = frame("a STRING, b STRING", ("{{b}} $1 \\", None))
    got = rows.select(text.fill("<{{a}}|{{b}}>", {"a": F.col("a"), "b": F.col("b")}).alias("x")).first().x
    assert got == "<{{b}} $1 \\|>"


def test_digits(frame):
    assert one(frame, text.is_digits, "12", "1a", "", None) == [True, False, False, False]
