"""Changes of stored tables, each rewriting only the partitions that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import pinned
from saleroom.functions.time import interval, ntz
from saleroom.plans import changes
from saleroom.sources.partitions import Done, PartitionedTables


def mark_messages_read(store: PartitionedTables, ids: DataFrame) -> Done:
    return store.change("messages", store.parts_of("messages", ids), lambda rows: changes.mark_messages_read(rows, ids))


def mark_sales_paid(store: PartitionedTables, paid: DataFrame, as_of: str) -> Done:
    """Set paid flags from (id, is_paid)."""
    return store.change("sales", store.parts_of("sales", paid.select("id")), lambda rows: changes.mark_paid(rows, paid, as_of))


def patch(store: PartitionedTables, table: str, new: DataFrame, order: list[str] | None = None) -> Done:
    """Update rows field by field from (id, …); NULL keeps the old value."""
    return store.change(table, store.parts_of(table, new.select("id")), lambda rows: changes.patch(rows, new, order=order))


def delete(store: PartitionedTables, table: str, ids: DataFrame) -> Done:
    gone = ids.toDF("id").distinct()
    return store.change(table, store.parts_of(table, gone), lambda rows: rows.join(gone, "id", "left_anti").select(*rows.columns))


def upsert_addresses(store: PartitionedTables, new: DataFrame, as_of: str) -> Done:
    """Addresses of users: the newest one of each is updated in its partition, users without one get a row."""
    current = store.read("addresses")
    result = changes.upsert_addresses(current, new, as_of)
    # only the changed rows: those of the users named
    of_users = pinned(result.join(new.select("user_id").distinct(), "user_id", "left_semi").select(*current.columns))
    fresh = pinned(of_users.join(current.select("id"), "id", "left_anti"))
    changed = of_users.join(fresh.select("id"), "id", "left_anti")
    done = store.change("addresses", store.parts_of("addresses", changed.select("id")), lambda rows: changes.overwrite(rows, changed))
    store.append("addresses", fresh)
    return done


def purge_notifications(store: PartitionedTables, as_of: str, days: int = changes.RETENTION_DAYS) -> Done:
    """Drop expired notifications: whole days go as folders, unread; only the day of the border is rewritten."""
    border = changes.retention_border(as_of, days)
    past = [d for d in store.days("notifications") if str(d) < border]
    for day in past:
        store.drop("notifications", day)
    on_border = [d for d in store.days("notifications") if str(d) == border]
    done = store.change("notifications", on_border, lambda rows: rows.where(F.col("created_at") >= ntz(as_of) - interval("DAY", days)))
    return Done(done.rewritten, done.dropped + len(past), done.written, done.removed)
