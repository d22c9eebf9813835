"""Keyed table changes: append, patch, overwrite, upsert, delete, flags.

Each function takes the current rows and the requested changes and returns the rows
of the next version; `saleroom.sources.snapshots` writes it. `as_of` is the time of
the change.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions.ids import with_new_ids
from saleroom.functions.time import interval, ntz
from saleroom.schemas import CASCADES, DEFAULTS


def with_defaults(rows: DataFrame, table: str, as_of: str) -> DataFrame:
    """Fill the columns of new rows the way the table's defaults do (absent or NULL)."""
    moment = f"TIMESTAMP_NTZ '{as_of}'"
    for name, sql in DEFAULTS[table].items():
        default = F.expr(sql.replace(":as_of", moment))
        if name in rows.columns:
            rows = rows.withColumn(name, F.coalesce(F.col(name), default))
        else:
            rows = rows.withColumn(name, default)
    return rows


def append(
    current: DataFrame, new: DataFrame, table: str, order: list[str], as_of: str
) -> DataFrame:
    """The table plus new rows with defaults and the next ids, numbered by `order`."""
    filled = with_defaults(with_new_ids(new, current, order), table, as_of)
    filled = filled.select(*[c for c in filled.columns if c in current.columns])
    return current.unionByName(filled, allowMissingColumns=True)


def latest_change(changes: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    """At most one change per key: the last one by `order` (none given: keys are unique)."""
    if not order:
        return changes
    rest = [c for c in changes.columns if c != key and c not in order]
    last = changes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in order + rest])


def _prefixed(changes: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(
        key, F.lit(True).alias("_matched"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    return renamed, fields


def patch(
    current: DataFrame, changes: DataFrame, key: str = "id",
    order: list[str] | None = None, always: dict[str, Column] | None = None,
) -> DataFrame:
    """Update matched rows field by field; a NULL in the change keeps the old value.

    `always` sets further columns of matched rows (a stamp, a forced owner).
    """
    new, fields = _prefixed(latest_change(changes, key, order), key)
    joined = current.join(new, key, "left")
    matched = F.coalesce("_matched", F.lit(False))
    columns = []
    for name in current.columns:
        value = F.col(name)
        if always and name in always:
            value = F.when(matched, always[name]).otherwise(value)
        elif name in fields and name != key:
            value = F.coalesce(F.col(f"_new_{name}"), value)
        columns.append(value.alias(name))
    return joined.select(*columns)


def overwrite(
    current: DataFrame, changes: DataFrame, key: str = "id",
    order: list[str] | None = None, always: dict[str, Column] | None = None,
) -> DataFrame:
    """Update matched rows with all fields of the change, NULLs included."""
    new, fields = _prefixed(latest_change(changes, key, order), key)
    joined = current.join(new, key, "left")
    matched = F.coalesce("_matched", F.lit(False))
    columns = []
    for name in current.columns:
        value = F.col(name)
        if name in fields and name != key:
            value = F.when(matched, F.col(f"_new_{name}")).otherwise(value)
        elif always and name in always:
            value = F.when(matched, always[name]).otherwise(value)
        columns.append(value.alias(name))
    return joined.select(*columns)


def set_where(current: DataFrame, keys: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """Set columns on the rows whose key is listed: flags, stamps, version counters.

    `values` may refer to the row's own columns, e.g. `F.col("version") + 1`.
    """
    marked = keys.toDF(key).distinct().withColumn("_matched", F.lit(True))
    matched = F.coalesce("_matched", F.lit(False))
    joined = current.join(marked, key, "left")
    columns = [
        (F.when(matched, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c)
        for c in current.columns
    ]
    return joined.select(*columns)


def upsert(
    current: DataFrame, changes: DataFrame, table: str, as_of: str, key: str = "user_id",
    order: list[str] | None = None,
) -> DataFrame:
    """Overwrite the row of each changed key, or insert one with defaults. Keys are unique.

    One full outer join on the key; new rows get ids when the table has them.
    """
    last = latest_change(changes, key, order)
    updated = overwrite(current, last, key, always={"updated_at": ntz(as_of)})
    fresh = last.join(current.select(key), key, "left_anti")
    return _with_inserts(updated, current, fresh, table, as_of, key)


def upsert_addresses(
    current: DataFrame, changes: DataFrame, as_of: str, order: list[str] | None = None
) -> DataFrame:
    """The same for addresses, of which a user may have many: the newest one is updated."""
    last = latest_change(changes, "user_id", order)
    if "country_code" not in last.columns:
        last = last.withColumn("country_code", F.lit("US"))
    last = last.withColumn("country_code", F.coalesce("country_code", F.lit("US")))
    newest = current.groupBy("user_id").agg(
        F.max(F.struct("created_at", "id")).alias("_newest")
    ).select("user_id", F.col("_newest.id").alias("id"))
    by_id = last.join(newest, "user_id").drop("user_id")
    updated = overwrite(current, by_id, "id", always={"updated_at": ntz(as_of)})
    fresh = last.join(newest, "user_id", "left_anti")
    return _with_inserts(updated, current, fresh, "addresses", as_of, "user_id")


def _with_inserts(
    updated: DataFrame, current: DataFrame, fresh: DataFrame, table: str, as_of: str, key: str
) -> DataFrame:
    if "id" in current.columns:
        fresh = with_new_ids(fresh, current, [key])
    filled = with_defaults(fresh, table, as_of)
    filled = filled.select(*[c for c in filled.columns if c in current.columns])
    return updated.unionByName(filled, allowMissingColumns=True)


def delete(
    tables: dict[str, DataFrame], parent: str, keys: DataFrame, also: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Delete rows by key, and the children the schema says go with them.

    `also` names further (table: key column) pairs to remove with the parent, for
    children without a cascade of their own. Only the given tables are followed.
    Returns the next version of every table touched: anti-joins on key sets.
    """
    doomed: dict[str, list[tuple[str, DataFrame]]] = {}

    def follow(table: str, column: str, gone: DataFrame) -> None:
        doomed.setdefault(table, []).append((column, gone))
        children = [(c, k) for c, k in CASCADES.get(table, []) if c in tables]
        if table == parent:
            children += list((also or {}).items())
        if not children:
            return
        ids = gone
        if column != "id":
            ids = tables[table].join(gone, column, "left_semi").select("id")
        for child, child_key in children:
            follow(child, child_key, ids.toDF(child_key))

    follow(parent, "id", keys.toDF("id").distinct())
    result = {}
    for table, reasons in doomed.items():
        kept = tables[table]
        for column, gone in reasons:
            kept = kept.join(gone, column, "left_anti")
        result[table] = kept
    return result


def soft_delete(listings: DataFrame, keys: DataFrame, as_of: str) -> DataFrame:
    """Mark listings as deleted; the rows stay."""
    if "deleted_at" not in listings.columns:
        listings = listings.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    return set_where(listings, keys, {"is_deleted": F.lit(True), "deleted_at": ntz(as_of)})


def mark_paid(sales: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Set the paid flag from (id, is_paid) changes; `paid_at` follows it."""
    if "paid_at" not in sales.columns:
        sales = sales.withColumn("paid_at", F.lit(None).cast("timestamp_ntz"))
    return overwrite(
        sales, changes.withColumn("paid_at", F.when(F.col("is_paid"), ntz(as_of)))
    )


def mark_result_paid(results: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the paid flag of auction results from (auction_id, is_paid) changes."""
    return overwrite(results, changes, "auction_id")


def mark_messages_read(messages: DataFrame, message_ids: DataFrame) -> DataFrame:
    return set_where(messages, message_ids, {"is_read": F.lit(True)})


def mark_notifications_read(notifications: DataFrame, user_ids: DataFrame) -> DataFrame:
    return set_where(notifications, user_ids, {"is_read": F.lit(True)}, "user_id")


def touch_mail_times(
    profiles: DataFrame, outcomes: DataFrame, as_of: str, column: str = "last_auction_email_at"
) -> DataFrame:
    """Move a last-mail time for the users a mail was really sent to."""
    done = outcomes.where("sent").select("user_id")
    return set_where(profiles, done, {column: ntz(as_of)}, "user_id")


RETENTION_DAYS = 30


def retention_border(as_of: str, days: int = RETENTION_DAYS) -> str:
    """The day on which the retention period begins, as it names a folder."""
    return (dt.datetime.fromisoformat(as_of) - dt.timedelta(days=days)).date().isoformat()


def expired_notifications(notifications: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """What a purge removes."""
    return notifications.where(F.col("created_at") < ntz(as_of) - interval("DAY", days))


def purge_notifications(notifications: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep notifications that are not older than the retention period.

    Where the table is stored in day folders (`created_date`), the expired days are not
    even read.
    """
    cutoff = ntz(as_of) - interval("DAY", days)
    kept = notifications.where(F.col("created_at") >= cutoff)
    if "created_date" in notifications.columns:
        kept = kept.where(F.col("created_date") >= cutoff.cast("date"))
    return kept
