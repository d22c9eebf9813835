from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleroom.operators import listings
from tests.conftest import tuples

POST = (
    "id BIGINT, title STRING, category STRING, description STRING, image_url STRING, price STRING, "
    "author_id BIGINT, hide BOOLEAN, is_deleted BOOLEAN, created_at TIMESTAMP_NTZ"
)


def post(i, title="t", category="misc", description="d", image=None, price="100", author=1, hide=False, deleted=False):
    return (i, title, category, description, image, price, author, hide, deleted, f"2024-01-{i:02d} 00:00:00")


@pytest.fixture
def corpus(frame):
    return frame(
        POST,
        post(1, title="Zephyr Marble"),
        post(2, title="Blue Spoon", category="zephyr ware"),
        post(3, title="Green Pipe", description="like a ZEPHYR"),
        post(4, title="Zephyr hidden", hide=True),
        post(5, title="Zephyr deleted", deleted=True),
        post(6, title="Zephyr unset", hide=None),
    )


def test_visible_is_newest_first_and_drops_unknown_flags(corpus):
    assert [r.id for r in listings.visible(corpus).collect()] == [3, 2, 1]


@pytest.mark.parametrize("term, ids", [("zephyr", {1, 2, 3}), ("eph", {1, 2, 3}), ("nothing", set()), ("s_oon", {2})])
def test_search(corpus, term, ids):
    assert {r.id for r in listings.search(corpus, term).collect()} == ids


def test_search_terms_gives_one_row_per_term_and_listing(corpus):
    found = listings.search_terms(corpus, ["zephyr", "SPOON", "zephyr"])
    assert tuples(found, "term", "id") == [("SPOON", 2), ("zephyr", 1), ("zephyr", 2), ("zephyr", 3)]


def test_cards_take_the_lowest_id_image_and_do_not_multiply(corpus, frame):
    images = frame(
        "id BIGINT, post_id BIGINT, image_url STRING", (12, 1, "second.jpg"), (11, 1, "first.jpg"), (13, 4, "x.jpg")
    )
    cards = listings.cards(corpus, images)
    assert tuples(cards, "id", "fallback_image_url") == [(1, "first.jpg"), (2, None), (3, None)]


def test_editable_is_own_listings_plus_all_for_the_admin(frame):
    posts = frame(POST, post(1, author=1), post(2, author=2), post(3, author=9))
    people = frame("id BIGINT, email STRING", (1, "boss@x"), (2, "u@x"))
    pairs = listings.editable(posts, people, "boss@x")
    assert tuples(pairs, "user_id", "post_id") == [(1, 1), (1, 2), (1, 3), (2, 2)]
    assert tuples(listings.editable(posts, people, "nobody@x"), "user_id", "post_id") == [(1, 1), (2, 2)]
    assert tuples(listings.may_manage(people, ["boss@x"]), "id", "is_admin") == [(1, True), (2, False)]


def test_inventory_totals_skip_text_prices(frame):
    posts = frame(POST, post(1, price="10.50"), post(2, price="ask"), post(3, price="5 usd"))
    row = listings.inventory_totals(posts).first()
    assert (row.n_items, str(row.total_value)) == (3, "15.50")


def test_dropped_urls_keep_duplicates(frame):
    lists = frame("old ARRAY<STRING>, new ARRAY<STRING>", (["a", "b", "b", "c"], ["a"]), (None, ["a"]), (["a"], None))
    got = lists.select(listings.dropped_from_lists(F.col("old"), F.col("new")).alias("x")).collect()
    assert [r.x for r in got] == [["b", "b", "c"], [], ["a"]]


def test_orphaned_images_have_their_storage_key(frame):
    old = frame("post_id BIGINT, image_url STRING", (1, "http://h/a/b.jpg"), (1, "http://h/keep.jpg"), (2, "not a url"))
    new = frame("post_id BIGINT, image_url STRING", (1, "http://h/keep.jpg"))
    got = listings.orphaned_images(old, new)
    assert tuples(got, "post_id", "storage_key") == [(1, "a/b.jpg"), (2, None)]


def test_image_rows_keep_their_order(frame):
    lists = frame("post_id BIGINT, image_urls ARRAY<STRING>", (7, ["http://h/img1.jpg", "http://h/img2.jpg"]), (8, []))
    assert tuples(listings.image_rows(lists), "post_id", "position", "public_id") == [
        (7, 0, "img1.jpg"), (7, 1, "img2.jpg")
    ]


def test_keyed_reads(corpus, frame):
    keys = frame("k BIGINT", (1,), (1,), (99,))
    assert [r.id for r in listings.by_keys(corpus, keys).collect()] == [1]
    assert [r.id for r in listings.missing(corpus, keys).collect()] == [99]
