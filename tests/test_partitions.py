"""Stored tables: what a change rewrites, and what it leaves."""

from __future__ import annotations

import os

import pytest

from saleroom.plans import stored
from saleroom.sources.partitions import PartitionedTables
from saleroom.sources.snapshots import empty_table
from tests.conftest import tuples


@pytest.fixture
def store(spark, tmp_path):
    return PartitionedTables(spark, str(tmp_path / "db"), parts=32)


def fill(store, spark, table, rows):
    store.append(table, empty_table(spark, table).unionByName(rows, allowMissingColumns=True))


def files(store, table):
    """Every data file with the partition it lies in."""
    found = {}
    for folder, _, names in os.walk(store.path(table)):
        found |= {f"{folder}/{n}": os.path.basename(folder) for n in names if n.endswith(".parquet")}
    return found


def test_marking_ten_messages_rewrites_ten_partitions_at_most(spark, store, frame):
    fill(store, spark, "messages", spark.range(3000).selectExpr("id", "id % 7 AS conversation_id", "'x' AS message_content", "false AS is_read"))
    before = files(store, "messages")
    assert len(set(before.values())) == 32
    ten = frame("id BIGINT", *[(k,) for k in range(10, 20)], (99_999,))
    done = stored.mark_messages_read(store, ten)
    after = files(store, "messages")
    changed = {before[f] for f in before.keys() - after.keys()}
    assert len(changed) <= 10 + 1 and {after[f] for f in after.keys() - before.keys()} == changed
    assert done.rewritten == len(changed) and done.removed == 0 and done.written < 3000
    assert sorted(r["id"] for r in store.read("messages").where("is_read").collect()) == list(range(10, 20))
    assert store.read("messages").count() == 3000
    # repeating it changes nothing
    assert stored.mark_messages_read(store, ten).removed == 0 and store.read("messages").where("is_read").count() == 10


def test_purge_drops_day_folders_only(spark, store, frame):
    fill(store, spark, "notifications", frame(
        "id BIGINT, user_id BIGINT, created_at TIMESTAMP_NTZ", *[(k, k, f"2024-01-{k:02d} {12 + k % 2}:00:00") for k in range(1, 13)], (50, 7, "2024-01-07 20:00:00"), (60, 1, None)
    ))
    before = files(store, "notifications")
    done = stored.purge_notifications(store, "2024-02-06 18:00:00")  # everything before 2024-01-07 18:00
    after = files(store, "notifications")
    kept = {f for f, day in before.items() if day > "_day=2024-01-07"}
    assert kept <= after.keys() and {after[f] for f in after.keys() - kept} == {"_day=2024-01-07"}
    assert (done.rewritten, done.dropped, done.removed) == (1, 6, 1)
    assert tuples(store.read("notifications"), "id") == sorted([(k,) for k in [*range(8, 13), 50, 60]], key=str)
    again = stored.purge_notifications(store, "2024-02-06 18:00:00")
    assert (again.dropped, again.removed) == (0, 0)


def test_deleting_a_whole_partition_drops_it(spark, store, frame):
    fill(store, spark, "sales", frame("id BIGINT, post_id BIGINT, is_paid BOOLEAN", *[(k, k, False) for k in range(200)]))
    part = store.parts_of("sales", frame("id BIGINT", (5,)))
    ids = [r["id"] for r in store._stored("sales").collect() if r["_part"] == part[0]]
    done = stored.delete(store, "sales", frame("id BIGINT", *[(k,) for k in ids]))
    assert (done.rewritten, done.dropped, done.removed) == (0, 1, len(ids))
    assert store.read("sales").count() == 200 - len(ids)
    assert stored.delete(store, "sales", frame("id BIGINT")).rewritten == 0


def test_updates_in_place(spark, store, frame):
    fill(store, spark, "sales", frame("id BIGINT, post_id BIGINT, is_paid BOOLEAN", (1, 1, False), (2, 1, None), (3, 1, True)))
    stored.mark_sales_paid(store, frame("id BIGINT, is_paid BOOLEAN", (1, True), (3, False), (9, True)), "2024-01-05 00:00:00")
    assert [(i, p, str(t)) for i, p, t in tuples(store.read("sales"), "id", "is_paid", "paid_at")] == [(1, True, "2024-01-05 00:00:00"), (2, None, "None"), (3, False, "None")]
    stored.patch(store, "sales", frame("id BIGINT, tracking_number STRING, post_id BIGINT", (2, "T", None)))
    assert tuples(store.read("sales"), "id", "post_id", "tracking_number") == [(1, 1, None), (2, 1, "T"), (3, 1, None)]


def test_addresses_are_updated_or_added(spark, store, frame):
    fill(store, spark, "addresses", frame("id BIGINT, user_id BIGINT, city STRING, created_at TIMESTAMP_NTZ", (1, 5, "old", "2024-01-01"), (2, 5, "new", "2024-01-02"), (3, 6, "six", "2024-01-01")))
    new = frame("user_id BIGINT, city STRING", (5, "five"), (7, "seven"))
    stored.upsert_addresses(store, new, "2024-02-01 00:00:00")
    assert tuples(store.read("addresses"), "id", "user_id", "city") == [(1, 5, "old"), (2, 5, "five"), (3, 6, "six"), (4, 7, "seven")]
    stored.upsert_addresses(store, new, "2024-02-01 00:00:00")
    assert store.read("addresses").count() == 4
