"""Notifications and mail: recipients, decisions, cooldowns, outbox rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleroom.functions import cooldown, text
from saleroom.functions.ordering import newest
from saleroom.functions.skew import in_parts, with_last_link
from saleroom.functions.time import epoch_micros, interval, ntz

# Minutes between two mails of a kind, days a notification is kept.
ITEM_COOLDOWN_MINUTES = 120
MESSAGE_THROTTLE_MINUTES = 20
RETENTION_DAYS = 30
# Subjects and the stand-in for an empty preview.
AUCTION_SUBJECT = "New Auction Posted: "
LISTING_SUBJECT = "New Gallery Post: "
TRACKING_SUBJECT = "Your package has shipped!"
MESSAGE_SUBJECT = "You have a new message"
EMPTY_PREVIEW = "Open your inbox to view the message."

SITE = "https://shop.example"


def unread(notifications: DataFrame) -> DataFrame:
    """Unread notifications, newest first."""
    return notifications.where(~F.col("is_read")).orderBy(newest("created_at"), newest("id"))


def unread_badges(notifications: DataFrame, messages: DataFrame) -> DataFrame:
    """Unread notifications and unread customer messages per user."""
    marks = notifications.where(~F.col("is_read")).select("user_id", F.lit("n").alias("kind")).unionByName(
        messages.where((F.col("is_read") == F.lit(False)) & (F.col("is_from_admin") == F.lit(False)))
        .select("user_id", F.lit("m").alias("kind"))
    )
    return marks.groupBy("user_id").agg(
        F.count_if(F.col("kind") == "n").alias("unread_notifications"),
        F.count_if(F.col("kind") == "m").alias("unread_messages"),
    )


def opted_in(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Users who want mail, with their address and the times of their last mails."""
    times = [
        c for c in ("last_auction_email_at", "last_post_email_at", "last_message_email_at") if c in profiles.columns
    ]
    wanted = profiles.where("send_email_notifications").select(
        "user_id", "send_email_notifications", *times
    )
    return wanted.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")


def cooled_down(last: Column, as_of: Column, minutes: int = ITEM_COOLDOWN_MINUTES) -> Column:
    """Never mailed, or strictly longer ago than the cooldown."""
    return last.isNull() | (last + interval("MINUTE", minutes) < as_of)


def item_mail_recipients(
    profiles: DataFrame, users: DataFrame, as_of: str, last: str = "last_auction_email_at"
) -> DataFrame:
    """Opted-in users whose last mail of this kind is old enough at `as_of`."""
    return opted_in(profiles, users).where(cooled_down(F.col(last), ntz(as_of)))


def message_mail_reason(profile_opt_in: Column, last: Column, is_admin: Column, as_of: Column) -> Column:
    """'opted-out', 'throttled' or 'send'; the admin skips the throttle, not the opt-in."""
    recent = F.coalesce(last + interval("MINUTE", MESSAGE_THROTTLE_MINUTES) > as_of, F.lit(False))
    return (
        F.when(~F.coalesce(profile_opt_in, F.lit(False)), "opted-out")
        .when(recent & ~is_admin, "throttled")
        .otherwise("send")
    )


def message_mail_decision(
    messages: DataFrame, profiles: DataFrame, as_of: str, admin_id: int, recipient: str = "user_id"
) -> DataFrame:
    """Each message with the mail decision for its recipient."""
    wishes = profiles.select(
        F.col("user_id").alias(recipient),
        F.col("send_email_notifications").alias("_opt_in"),
        F.col("last_message_email_at").alias("_last"),
    )
    reason = message_mail_reason(
        F.col("_opt_in"), F.col("_last"), F.col(recipient) == admin_id, ntz(as_of)
    )
    return messages.join(wishes, recipient, "left").withColumn("reason", reason).drop("_opt_in", "_last")


# ---- greedy cooldown over many arrivals ------------------------------------------------


def mail_after_cooldown(
    arrivals: DataFrame,
    key: str = "user_id",
    at: str = "sent_at",
    minutes: int = ITEM_COOLDOWN_MINUTES,
    last_mails: DataFrame | None = None,
) -> DataFrame:
    """The arrivals that lead to a mail: the first, then each first one after the cooldown.

    `last_mails` (key, last) holds earlier mails; arrivals inside their cooldown drop
    out. Distinct times per key are taken first (combined map-side) and cut into even
    parts by (key, time). Only a part's first and last key can go on in another part;
    for these the part states how its last mail follows from the last mail before it.
    The states are chained, a row per part, and each part then finds its own mails.
    """
    gap = minutes * 60_000_000
    if last_mails is not None:
        arrivals = (
            arrivals.join(last_mails.toDF(key, "_last"), key, "left")
            .where(F.col("_last").isNull() | (F.col("_last") + interval("MINUTE", minutes) < F.col(at)))
            .drop("_last")
        )
    times = arrivals.select(F.col(key).cast("bigint").alias("_k"), epoch_micros(F.col(at)).alias("_t")).distinct()
    parts = in_parts(times, ["_k", "_t"])
    entered = with_last_link(parts, gap).select("_k", "_t", "_last")
    sent = entered.mapInArrow(cooldown.mails(gap), "_k bigint, _t bigint")
    epoch = ntz("1970-01-01 00:00:00")
    kind = dict(arrivals.dtypes)[key]
    return sent.select(F.col("_k").cast(kind).alias(key), F.timestamp_add("MICROSECOND", F.col("_t"), epoch).alias(at))


# ---- delivery ---------------------------------------------------------------------------


def delivery_totals(outcomes: DataFrame) -> DataFrame:
    """Totals over (user_id, sent) outcome rows."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if("sent").alias("sent"),
        F.count_if(~F.coalesce("sent", F.lit(False))).alias("failed"),
    )


def notification_feed(*sources: DataFrame) -> DataFrame:
    """Notifications from several sources in one table."""
    columns = ["user_id", "auction_id", "type", "created_at"]
    return functools.reduce(DataFrame.unionByName, [s.select(*columns) for s in sources])


# ---- outbox -----------------------------------------------------------------------------


def _item(items: DataFrame, newest_by: str) -> Column:
    """The newest item as one struct value (a scalar subquery, not a join)."""
    return items.agg(F.max_by(F.struct(*items.columns), F.col(newest_by))).scalar()


def auction_outbox(
    recipients: DataFrame, auctions: DataFrame, newest_by: str = "id", site: str = SITE
) -> DataFrame:
    """One mail per recipient about the newest auction."""
    rows = recipients.withColumn("_item", _item(auctions, newest_by))
    item = F.col("_item")
    return rows.select(
        "user_id",
        F.col("email").alias("to_address"),
        F.concat(F.lit(AUCTION_SUBJECT), F.coalesce(item["title"], F.lit(""))).alias("subject"),
        F.coalesce(item["title"], F.lit("")).alias("title"),
        F.coalesce(item["description"], F.lit("")).alias("description"),
        F.coalesce(F.get(item["image_urls"], F.lit(0)), F.lit("")).alias("image_url"),
        F.concat(F.lit(f"{site}/auctions/"), item["id"].cast("string")).alias("item_url"),
        F.lit(site).alias("home_url"),
    )


def listing_outbox(
    recipients: DataFrame, listings: DataFrame, newest_by: str = "id", site: str = SITE
) -> DataFrame:
    """One mail per recipient about the newest listing."""
    rows = recipients.withColumn("_item", _item(listings, newest_by))
    item = F.col("_item")
    return rows.select(
        "user_id",
        F.col("email").alias("to_address"),
        F.concat(F.lit(LISTING_SUBJECT), F.coalesce(item["title"], F.lit(""))).alias("subject"),
        F.coalesce(item["title"], F.lit("")).alias("title"),
        F.coalesce(item["description"], F.lit("")).alias("description"),
        F.coalesce(item["image_url"], F.lit("")).alias("image_url"),
        F.concat(F.lit(f"{site}/"), item["id"].cast("string")).alias("item_url"),
        F.lit(site).alias("home_url"),
    )


def tracking_outbox(
    shipments: DataFrame, users: DataFrame, site: str = SITE, kind: str = "sale", receiver: str = "buyer_id"
) -> DataFrame:
    """One mail per shipment with a tracking number; blank numbers are left out.

    `kind` is "sale" (to the buyer) or "auction" (rows of auction results, to `winner_id`).
    """
    emails = users.select(F.col("id").alias(receiver), F.col("email").alias("to_address"))
    return (
        shipments.where(F.coalesce("tracking_number", F.lit("")) != "")
        .join(emails, receiver)
        .select(
            F.lit(kind).alias("kind"), F.col("id").alias(f"{kind}_id"), "to_address",
            F.lit(TRACKING_SUBJECT).alias("subject"), "tracking_number",
            text.tracking_link(F.col("tracking_number")).alias("tracking_url"),
            F.lit(site).alias("home_url"),
        )
    )


def message_outbox(decided: DataFrame, users: DataFrame, site: str = SITE) -> DataFrame:
    """Mail rows for the messages whose decision is 'send': (id, recipient_id, message_content)."""
    emails = users.select(F.col("id").alias("recipient_id"), F.col("email").alias("to_address"))
    body = text.html_body(text.preview(F.col("message_content")))
    return (
        decided.where(F.col("reason") == "send")
        .join(emails, "recipient_id")
        .select(
            F.col("id").alias("message_id"), "recipient_id", "to_address",
            F.lit(MESSAGE_SUBJECT).alias("subject"),
            F.when(body == "", F.lit(EMPTY_PREVIEW)).otherwise(body).alias("preview_html"),
            F.lit(f"{site}/messages").alias("inbox_url"),
        )
    )


def broadcast_outbox(
    recipients: DataFrame, subject: str, message: str, site: str = SITE
) -> DataFrame:
    """One mail per opted-in user, without a cooldown. Blank subject or text is an error."""
    subject, message = subject.strip(), message.strip()
    if not subject or not message:
        raise ValueError("subject and message are required")
    return recipients.select(
        "user_id",
        F.col("email").alias("to_address"),
        F.lit(subject).alias("subject"),
        text.escape_html(F.lit(subject)).alias("subject_html"),
        text.html_body(F.lit(message)).alias("body_html"),
        F.lit(site).alias("home_url"),
    )
