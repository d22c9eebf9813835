"""The query catalogue: each entry pairs a Spark query with the same answer in SQL.

A query takes a `Marketplace` and returns a DataFrame; its SQL runs in DuckDB over the
same parquet tables. Nested values are flattened here so both sides compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleroom.functions import text
from saleroom.functions.ids import pinned
from saleroom.operators import auctions, listings, messaging, notify, quality, sales, search, users
from saleroom.plans import changes, closing, conversations, stored, trade
from saleroom.session import scratch_path
from saleroom.sources.partitions import PartitionedTables
from saleroom.sources.snapshots import empty_table
from saleroom.sources.tables import read_table
from saleroom.sources.views import AS_OF, PURGE_AS_OF, Marketplace, with_views
from saleroom.streaming import bids as live_bids
from saleroom.streaming import closing as live_closing
from saleroom.streaming import fanout, inbox, intake, live, mail, routing, seats, windows
from saleroom.streaming.runner import replay, replay_deliveries, replay_updates

Query = Callable[[Marketplace], DataFrame]

ADMIN_ID = 1
ADMIN_EMAIL = "customer#000000001@example.com"
SEARCH_TERM = "RED"
DISCOUNT = 15
SECRET = "not a real secret"
BROADCAST = ("Spring & summer hours", 'We are open "late".\nSee <you> & yours soon')

CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(
    name: str, sql: str | None = None, money: tuple[str, ...] = ()
) -> Callable[[Query], Query]:
    """Register a query. `money` columns are decimals; both sides show them as doubles."""

    def register(build: Query) -> Query:
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        filled = sql and sql.replace(":as_of", f"TIMESTAMP '{AS_OF}'")
        if filled and money:
            shown = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money)
            filled = f"SELECT * REPLACE ({shown}) FROM ({filled}) AS amounts"

        def shown_build(m: Marketplace) -> DataFrame:
            result = build(m)
            return result.withColumns({c: F.col(c).cast("double") for c in money}) if money else result

        CATALOGUE[name] = (shown_build, filled and with_views(filled))
        return build

    return register


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Marketplace(spark, folder))

    return {name: bind(build) for name, (build, _) in CATALOGUE.items()}


def oracle_queries() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}


# ---- scans, exports, logs ---------------------------------------------------------------


@query("scan_profiles", "SELECT * FROM v_profiles")
def scan_profiles(m: Marketplace) -> DataFrame:
    return m["v_profiles"]


@query("scan_addresses", "SELECT * FROM v_addresses")
def scan_addresses(m: Marketplace) -> DataFrame:
    return m["v_addresses"].orderBy(F.col("created_at").desc_nulls_first(), "id")


@query("inventory_export", """
    SELECT strftime(created_at, '%m/%d/%Y') AS created_at, title, description, image_url, category, price
    FROM v_posts
""")
def inventory_export(m: Marketplace) -> DataFrame:
    return listings.inventory_export(m["v_posts"])


@query("recent_errors", "SELECT * FROM v_errors ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_errors(m: Marketplace) -> DataFrame:
    return quality.recent_errors(m["v_errors"])


@query("auction_json", """
    SELECT id, CAST(to_json(struct_pack(
        id := id, title := title, description := description, "imageUrls" := image_urls,
        "startPrice" := start_price, "buyNowPrice" := buy_now_price,
        "endTime" := strftime(end_time, '%Y-%m-%dT%H:%M:%S.000Z'),
        "isActive" := is_active, "creatorId" := creator_id)) AS VARCHAR) AS json
    FROM v_auctions
""")
def auction_json(m: Marketplace) -> DataFrame:
    return auctions.as_json(m["v_auctions"])


# ---- filters ----------------------------------------------------------------------------


@query("visible_listings", "SELECT * FROM v_posts WHERE hide = FALSE AND is_deleted = FALSE")
def visible_listings(m: Marketplace) -> DataFrame:
    return listings.visible(m["v_posts"])


@query("search_listings", f"""
    SELECT * FROM v_posts
    WHERE hide = FALSE AND is_deleted = FALSE
      AND (title ILIKE '%{SEARCH_TERM}%' OR category ILIKE '%{SEARCH_TERM}%' OR description ILIKE '%{SEARCH_TERM}%')
""")
def search_listings(m: Marketplace) -> DataFrame:
    return listings.search(m["v_posts"], SEARCH_TERM)


@query("search_many_terms", """
    SELECT t.term, p.id, p.title, p.category, p.description
    FROM v_posts p, (VALUES ('ring'), ('brand#7'), ('l%t')) AS t(term)
    WHERE hide = FALSE AND is_deleted = FALSE
      AND (title ILIKE '%' || term || '%' OR category ILIKE '%' || term || '%'
           OR description ILIKE '%' || term || '%')
""")
def search_many_terms(m: Marketplace) -> DataFrame:
    found = listings.search_terms(m["v_posts"], ["ring", "brand#7", "l%t"])
    return found.select("term", "id", "title", "category", "description")


@query("search_term_table", """
    SELECT t.term, p.id, p.title, p.category, p.description
    FROM v_posts p JOIN (SELECT DISTINCT term FROM v_terms) t
      ON title ILIKE '%' || term || '%' OR category ILIKE '%' || term || '%' OR description ILIKE '%' || term || '%'
    WHERE hide = FALSE AND is_deleted = FALSE
""")
def search_term_table(m: Marketplace) -> DataFrame:
    found = search.search_table(m["v_posts"], m["v_terms"])
    return found.select("term", "id", "title", "category", "description")


@query("listings_by_key", "SELECT * FROM v_posts WHERE id IN (SELECT post_id FROM v_sales WHERE NOT is_paid)")
def listings_by_key(m: Marketplace) -> DataFrame:
    wanted = m["v_sales"].where(~F.col("is_paid")).select("post_id")
    return listings.by_keys(m["v_posts"], wanted)


@query("missing_keys", """
    SELECT DISTINCT buyer_id AS user_id FROM v_sales
    WHERE buyer_id NOT IN (SELECT user_id FROM v_profiles)
""")
def missing_keys(m: Marketplace) -> DataFrame:
    return listings.missing(m["v_profiles"], m["v_sales"].select("buyer_id"), "user_id")


@query("listings_by_author", "SELECT * FROM v_posts")
def listings_by_author(m: Marketplace) -> DataFrame:
    return listings.by_author(m["v_posts"])


@query("auctions_by_end", "SELECT id, title, start_price, buy_now_price, end_time, is_active FROM v_auctions")
def auctions_by_end(m: Marketplace) -> DataFrame:
    return auctions.by_end_time(m["v_auctions"]).select(
        "id", "title", "start_price", "buy_now_price", "end_time", "is_active"
    )


@query("unread_notifications", "SELECT * FROM v_notifications WHERE is_read = FALSE")
def unread_notifications(m: Marketplace) -> DataFrame:
    return notify.unread(m["v_notifications"])


@query("expired_auctions", "SELECT id, end_time FROM v_auctions WHERE is_active = TRUE AND end_time <= :as_of")
def expired_auctions(m: Marketplace) -> DataFrame:
    return auctions.expired(m["v_auctions"], AS_OF).select("id", "end_time")


@query("auction_schedule", """
    SELECT id, end_time,
           CAST(greatest(0, floor(date_diff('microsecond', :as_of, end_time) / 1000000.0)) AS BIGINT) AS seconds_left,
           end_time <= :as_of AS overdue
    FROM v_auctions WHERE is_active
""")
def auction_schedule(m: Marketplace) -> DataFrame:
    return auctions.schedule(m["v_auctions"], AS_OF)


@query("auction_mail_recipients", """
    SELECT p.user_id, u.email, p.last_auction_email_at
    FROM v_profiles p JOIN v_users u ON p.user_id = u.id
    WHERE p.send_email_notifications
      AND (p.last_auction_email_at IS NULL OR p.last_auction_email_at < :as_of - INTERVAL 120 MINUTE)
""")
def auction_mail_recipients(m: Marketplace) -> DataFrame:
    return notify.item_mail_recipients(m["v_profiles"], m["v_users"], AS_OF).select(
        "user_id", "email", "last_auction_email_at"
    )


def _post_mail_profiles(m: Marketplace) -> DataFrame:
    # the time of the last message mail stands in for the last listing mail
    return m["v_profiles"].withColumnRenamed("last_message_email_at", "last_post_email_at")


@query("post_mail_recipients", """
    SELECT p.user_id, u.email, p.last_message_email_at AS last_post_email_at
    FROM v_profiles p JOIN v_users u ON p.user_id = u.id
    WHERE p.send_email_notifications
      AND (p.last_message_email_at IS NULL
           OR date_diff('microsecond', p.last_message_email_at, TIMESTAMP '2024-01-16 01:30:00') > 7200000000)
""")
def post_mail_recipients(m: Marketplace) -> DataFrame:
    return notify.item_mail_recipients(
        _post_mail_profiles(m), m["v_users"], "2024-01-16 01:30:00", "last_post_email_at"
    ).select("user_id", "email", "last_post_email_at")


@query("message_mail_decision", f"""
    SELECT n.id, n.user_id, n.sent_at,
           CASE WHEN p.user_id IS NULL OR NOT p.send_email_notifications THEN 'opted-out'
                WHEN n.user_id <> {ADMIN_ID}
                     AND date_diff('microsecond', p.last_message_email_at, :as_of) < 20 * 60000000 THEN 'throttled'
                ELSE 'send' END AS reason
    FROM v_new_messages n LEFT JOIN v_profiles p ON p.user_id = n.user_id
""")
def message_mail_decision(m: Marketplace) -> DataFrame:
    return notify.message_mail_decision(m["v_new_messages"], m["v_profiles"], AS_OF, ADMIN_ID)


@query("address_quality", """
    SELECT id, user_id,
           CASE WHEN n_filled = 4 THEN 'complete' WHEN n_filled > 0 THEN 'partial' ELSE 'none' END AS quality
    FROM (SELECT id, user_id,
                 CAST(trim(coalesce(address_line1, '')) <> '' AS INT) + CAST(trim(coalesce(city, '')) <> '' AS INT)
                 + CAST(trim(coalesce(state, '')) <> '' AS INT)
                 + CAST(trim(coalesce(postal_code, '')) <> '' AS INT) AS n_filled
          FROM v_addresses) a
""")
def address_quality(m: Marketplace) -> DataFrame:
    return users.address_quality(m["v_addresses"]).select("id", "user_id", "quality")


@query("bid_input_check", """
    SELECT id, auction_id, user_id, bid_amount,
           concat_ws('; ',
               CASE WHEN coalesce(auction_id, 0) = 0 THEN 'auction_id is required' END,
               CASE WHEN coalesce(user_id, 0) = 0 THEN 'user_id is required' END,
               CASE WHEN coalesce(bid_amount, 0) = 0 THEN 'bid_amount is required' END) AS failed
    FROM v_bids
""")
def bid_input_check(m: Marketplace) -> DataFrame:
    return quality.check(m["v_bids"], quality.bid_rules()).select(
        "id", "auction_id", "user_id", "bid_amount", F.array_join("failed", "; ").alias("failed")
    )


@query("sale_input_check", """
    SELECT id, post_id, buyer_email, price,
           concat_ws('; ',
               CASE WHEN coalesce(buyer_email, '') = '' THEN 'buyer_email is required' END,
               CASE WHEN coalesce(post_id, 0) = 0 THEN 'post_id is required' END,
               CASE WHEN coalesce(price, 0) = 0 THEN 'price is required' END) AS failed
    FROM v_sale_input
""", money=("price",))
def sale_input_check(m: Marketplace) -> DataFrame:
    return quality.check(m["v_sale_input"], quality.sale_rules()).select(
        "id", "post_id", "buyer_email", "price", F.array_join("failed", "; ").alias("failed")
    )


@query("editable_listings", f"""
    SELECT u.id AS user_id, p.id AS post_id
    FROM v_posts p JOIN v_users u ON p.author_id = u.id OR u.email = '{ADMIN_EMAIL}'
""")
def editable_listings(m: Marketplace) -> DataFrame:
    return listings.editable(m["v_posts"], m["v_users"], ADMIN_EMAIL)


@query("bid_history", "SELECT * FROM v_bids")
def bid_history(m: Marketplace) -> DataFrame:
    return auctions.bid_history(m["v_bids"])


@query("user_bids", "SELECT * FROM v_bids")
def user_bids(m: Marketplace) -> DataFrame:
    return auctions.user_bids(m["v_bids"])


@query("user_addresses", "SELECT * FROM v_addresses")
def user_addresses(m: Marketplace) -> DataFrame:
    return users.addresses_by_user(m["v_addresses"])


# ---- joins ------------------------------------------------------------------------------


@query("user_wins", """
    SELECT r.id, r.auction_id, r.winner_id, r.final_bid, r.closed_at, r.closed_reason,
           coalesce(r.is_paid, FALSE) AS is_paid, a.title, a.buy_now_price,
           array_to_string(a.image_urls, ',') AS image_urls
    FROM v_results r JOIN v_auctions a ON a.id = r.auction_id
    WHERE r.winner_id IS NOT NULL
""")
def user_wins(m: Marketplace) -> DataFrame:
    wins = auctions.user_wins(m["v_results"], m["v_auctions"])
    return wins.withColumn("image_urls", F.array_join("image_urls", ","))


@query("admin_auctions", """
    SELECT a.id, a.title, a.end_time, a.is_active, r.is_paid
    FROM v_auctions a LEFT JOIN v_results r ON r.auction_id = a.id
""")
def admin_auctions(m: Marketplace) -> DataFrame:
    return auctions.for_admin(m["v_auctions"], m["v_results"]).select(
        "id", "title", "end_time", "is_active", "is_paid"
    )


@query("messages_with_email", """
    SELECT m.*, u.email AS user_email FROM v_messages m JOIN v_users u ON m.user_id = u.id
""")
def messages_with_email(m: Marketplace) -> DataFrame:
    return messaging.with_email(m["v_messages"], m["v_users"])


@query("user_thread_messages", """
    SELECT * FROM v_messages
    WHERE conversation_id IN (SELECT DISTINCT conversation_id FROM v_messages
                              WHERE user_id IN (SELECT id FROM v_users WHERE NOT is_verified))
""")
def user_thread_messages(m: Marketplace) -> DataFrame:
    return messaging.thread_messages(m["v_messages"], m["v_users"].where(~F.col("is_verified")))


@query("listing_cards", """
    WITH first_images AS (SELECT post_id AS id, min_by(image_url, id) AS fallback_image_url FROM v_imgs GROUP BY post_id)
    SELECT * FROM v_posts LEFT JOIN first_images USING (id) WHERE NOT hide AND NOT is_deleted
""")
def listing_cards(m: Marketplace) -> DataFrame:
    return listings.cards(m["v_posts"], m["v_imgs"])


@query("sales_report", """
    WITH buyers AS (
        SELECT v_users.id AS buyer_id, email AS buyer_email, first_name AS buyer_first_name, last_name AS buyer_last_name,
               CASE WHEN first_name IS NOT NULL AND last_name IS NOT NULL THEN concat(first_name, ' ', last_name) END AS buyer_name
        FROM v_profiles JOIN v_users ON v_users.id = v_profiles.user_id),
    items AS (SELECT id AS post_id, title AS post_title, image_url FROM v_posts)
    SELECT * FROM v_sales JOIN items USING (post_id) JOIN buyers USING (buyer_id)
""", money=("price",))
def sales_report(m: Marketplace) -> DataFrame:
    return sales.report(m["v_sales"], m["v_posts"], m["v_users"], m["v_profiles"])


@query("buyer_sales", """
    SELECT s.*, p.title AS post_title, p.image_url AS post_image_url, p.price AS post_price
    FROM v_sales s JOIN v_posts p ON p.id = s.post_id
""", money=("price",))
def buyer_sales(m: Marketplace) -> DataFrame:
    return sales.buyer_sales(m["v_sales"], m["v_posts"])


@query("users_by_profile_date", """
    SELECT u.*, p.created_at AS profile_created_at
    FROM v_users u LEFT JOIN v_profiles p ON p.user_id = u.id
""")
def users_by_profile_date(m: Marketplace) -> DataFrame:
    return users.by_profile_date(m["v_users"], m["v_profiles"])


@query("opted_in_users", """
    SELECT p.user_id, u.email, p.send_email_notifications, p.last_auction_email_at, p.last_message_email_at
    FROM v_profiles p JOIN v_users u ON p.user_id = u.id WHERE p.send_email_notifications
""")
def opted_in_users(m: Marketplace) -> DataFrame:
    return notify.opted_in(m["v_profiles"], m["v_users"])


@query("bids_with_profile", """
    SELECT b.id, b.auction_id, b.user_id, b.bid_amount, b.created_at,
           p.user_id IS NOT NULL AS has_profile, p.first_name, p.last_name
    FROM v_bids b LEFT JOIN v_profiles p ON p.user_id = b.user_id
""")
def bids_with_profile(m: Marketplace) -> DataFrame:
    return auctions.bids_with_profile(m["v_bids"], m["v_profiles"]).select(
        "id", "auction_id", "user_id", "bid_amount", "created_at",
        F.col("user").isNotNull().alias("has_profile"),
        F.col("user.first_name").alias("first_name"), F.col("user.last_name").alias("last_name"),
    )


@query("user_directory", """
    SELECT u.id, u.email, u.is_verified, p.first_name, p.last_name, a.id AS address_id, a.address_line1, a.city
    FROM v_users u
    LEFT JOIN v_profiles p ON p.user_id = u.id
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
               FROM v_addresses) a ON a.user_id = u.id AND a.rn = 1
""")
def user_directory(m: Marketplace) -> DataFrame:
    return users.directory(m["v_users"], m["v_profiles"], m["v_addresses"]).select(
        "id", "email", "is_verified", F.col("profile.first_name").alias("first_name"),
        F.col("profile.last_name").alias("last_name"), F.col("address.id").alias("address_id"),
        F.col("address.address_line1").alias("address_line1"), F.col("address.city").alias("city"),
    )


@query("sale_buyer_resolution", """
    SELECT s.id, s.post_id, s.buyer_email, s.price, u.id AS buyer_id
    FROM v_sale_input s JOIN v_users u ON u.email = s.buyer_email
""", money=("price",))
def sale_buyer_resolution(m: Marketplace) -> DataFrame:
    return sales.resolve_buyers(m["v_sale_input"], m["v_users"])[0]


@query("sale_buyer_rejects", """
    SELECT s.* FROM v_sale_input s
    WHERE NOT EXISTS (SELECT 1 FROM v_users u WHERE u.email = s.buyer_email)
""", money=("price",))
def sale_buyer_rejects(m: Marketplace) -> DataFrame:
    return sales.resolve_buyers(m["v_sale_input"], m["v_users"])[1]


@query("auction_outcomes", """
    SELECT r.auction_id, r.closed_reason, r.winner_id, p.first_name
    FROM v_results r LEFT JOIN v_profiles p ON p.user_id = r.winner_id
""")
def auction_outcomes(m: Marketplace) -> DataFrame:
    return auctions.outcomes(m["v_results"], m["v_profiles"])


@query("user_dashboard", """
    SELECT user_id, 'bid' AS section, id AS item_id, auction_id, bid_amount AS amount, created_at AS at,
           CAST(NULL AS VARCHAR) AS title
    FROM v_bids
    UNION ALL
    SELECT r.winner_id, 'win', r.id, r.auction_id, r.final_bid, r.closed_at, a.title
    FROM v_results r JOIN v_auctions a ON a.id = r.auction_id WHERE r.winner_id IS NOT NULL
""")
def user_dashboard(m: Marketplace) -> DataFrame:
    return auctions.user_dashboard(m["v_bids"], m["v_results"], m["v_auctions"])


# ---- aggregates -------------------------------------------------------------------------


@query("inbox_summary", """
    WITH totals AS (
        SELECT conversation_id, max(sent_at) AS last_message_at, count(*) AS message_count,
               count(*) FILTER (WHERE NOT is_read AND NOT is_from_admin) AS unread_count
        FROM v_messages GROUP BY conversation_id),
    people AS (SELECT u.id AS user_id, u.email, p.first_name, p.last_name
               FROM v_users u LEFT JOIN v_profiles p ON p.user_id = u.id)
    SELECT conversation_id, user_id, email, first_name, last_name, last_message_at, message_count, unread_count
    FROM totals SEMI JOIN v_messages USING (conversation_id)
    JOIN (SELECT conversation_id, user_id FROM v_messages GROUP BY ALL) seats USING (conversation_id)
    JOIN people USING (user_id)
""")
def inbox_summary(m: Marketplace) -> DataFrame:
    return messaging.inbox_summary(m["v_messages"], m["v_users"], m["v_profiles"])


@query("next_conversation_id", "SELECT coalesce(max(conversation_id), 0) + 1 AS next_id FROM v_messages")
def next_conversation_id(m: Marketplace) -> DataFrame:
    return messaging.next_conversation_id(m["v_messages"])


@query("participants", "SELECT DISTINCT conversation_id, user_id FROM v_messages")
def participants(m: Marketplace) -> DataFrame:
    return messaging.participants(m["v_messages"])


def _outcomes(m: Marketplace) -> DataFrame:
    sent = (F.col("user_id") % 9 != 0).alias("sent")
    return notify.opted_in(m["v_profiles"], m["v_users"]).select("user_id", sent)


@query("delivery_totals", """
    SELECT count(*) AS total, count(CASE WHEN user_id % 9 <> 0 THEN 1 END) AS sent,
           count(CASE WHEN user_id % 9 = 0 THEN 1 END) AS failed
    FROM v_profiles WHERE send_email_notifications
""")
def delivery_totals(m: Marketplace) -> DataFrame:
    return notify.delivery_totals(_outcomes(m))


@query("inventory_totals", """
    SELECT category, count(*) AS n_items, CAST(sum(TRY_CAST(price AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_value
    FROM v_posts GROUP BY category
""", money=("total_value",))
def inventory_totals(m: Marketplace) -> DataFrame:
    return listings.inventory_totals(m["v_posts"])


@query("outstanding_by_buyer", """
    SELECT buyer_id, count(*) AS n_unpaid, CAST(sum(price) AS DECIMAL(20,2)) AS outstanding
    FROM v_sales WHERE is_paid = FALSE GROUP BY buyer_id
""", money=("outstanding",))
def outstanding_by_buyer(m: Marketplace) -> DataFrame:
    return sales.outstanding_by_buyer(m["v_sales"])


@query("unread_badges", """
    SELECT user_id, CAST(sum(n) AS BIGINT) AS unread_notifications, CAST(sum(c) AS BIGINT) AS unread_messages
    FROM (SELECT user_id, 1 AS n, 0 AS c FROM v_notifications WHERE NOT is_read
          UNION ALL
          SELECT user_id, 0, 1 FROM v_messages WHERE is_read = FALSE AND is_from_admin = FALSE) x
    GROUP BY user_id
""")
def unread_badges(m: Marketplace) -> DataFrame:
    return notify.unread_badges(m["v_notifications"], m["v_messages"])


@query("current_bid", "SELECT auction_id, max(bid_amount) AS current_bid FROM v_bids GROUP BY auction_id")
def current_bid(m: Marketplace) -> DataFrame:
    return auctions.current_bid(m["v_bids"])


@query("job_counts", f"""
    SELECT 'swept' AS step, count(*) AS n_rows FROM v_auctions WHERE is_active AND end_time <= :as_of
    UNION ALL
    SELECT 'purged', count(*) FROM v_notifications
    WHERE created_at < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 30 DAY
""")
def job_counts(m: Marketplace) -> DataFrame:
    purged = changes.expired_notifications(m["v_notifications"], PURGE_AS_OF)
    return quality.job_counts({
        "swept": auctions.expired(m["v_auctions"], AS_OF), "purged": purged,
    })


# ---- ordered logic ----------------------------------------------------------------------


@query("top_bid", """
    SELECT auction_id, id AS bid_id, user_id, bid_amount, created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY bid_amount DESC, created_at, id) AS rn
          FROM v_bids) b
    WHERE rn = 1
""")
def top_bid(m: Marketplace) -> DataFrame:
    return auctions.top_bid(m["v_bids"])


_JUDGED = """
    SELECT *, max(bid_amount) OVER (PARTITION BY auction_id ORDER BY created_at, id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_amount
    FROM v_bids
"""


@query("accepted_bids", f"""
    SELECT id, auction_id, user_id, bid_amount, created_at FROM ({_JUDGED}) j
    WHERE prior_amount IS NULL OR bid_amount > prior_amount
""")
def accepted_bids(m: Marketplace) -> DataFrame:
    return auctions.accepted_bids(m["v_bids"])


@query("bid_ledger", f"""
    SELECT id, auction_id, user_id, bid_amount, created_at, prior_amount,
           coalesce(bid_amount > prior_amount, TRUE) AS accepted,
           CASE WHEN bid_amount <= prior_amount THEN 'not higher than the current bid' END AS reason
    FROM ({_JUDGED}) j
""")
def bid_ledger(m: Marketplace) -> DataFrame:
    return auctions.bid_ledger(m["v_bids"]).drop("prior_user_id")


@query("outbid_notices", f"""
    SELECT id AS bid_id, auction_id, loser AS user_id, bid_amount AS new_bid_amount, 'outbid' AS type, created_at
    FROM (SELECT *, lag(user_id) OVER (PARTITION BY auction_id ORDER BY created_at, id) AS loser
          FROM ({_JUDGED}) j WHERE prior_amount IS NULL OR bid_amount > prior_amount) a
    WHERE loser IS NOT NULL AND loser <> user_id
""")
def outbid_notices(m: Marketplace) -> DataFrame:
    return auctions.outbid_notices(m["v_bids"])


@query("latest_address", """
    SELECT user_id, id, address_line1, city, state, postal_code, created_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                                       ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC, id DESC) AS rn
          FROM v_addresses) a
    WHERE rn = 1
""")
def latest_address(m: Marketplace) -> DataFrame:
    return users.latest_address(m["v_addresses"])


_FIRST_CONVERSATION = """
    SELECT user_id, conversation_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent_at, id) AS rn FROM v_messages) x
    WHERE rn = 1
"""


@query("first_conversation", _FIRST_CONVERSATION)
def first_conversation(m: Marketplace) -> DataFrame:
    return messaging.first_conversation(m["v_messages"])


_REPLY_RECIPIENT = """
    SELECT conversation_id, user_id AS recipient_id
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, id) AS rn
          FROM v_messages WHERE NOT is_from_admin) x
    WHERE rn = 1
"""


@query("reply_recipient", _REPLY_RECIPIENT)
def reply_recipient(m: Marketplace) -> DataFrame:
    return messaging.reply_recipient(m["v_messages"])


# one bid at a time, as a recursive fold
_EXTENDED = """
    WITH RECURSIVE ordered AS (
        SELECT auction_id, created_at, row_number() OVER (PARTITION BY auction_id ORDER BY created_at, id) AS rn
        FROM v_bids),
    fold AS (
        SELECT id AS auction_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS extensions, end_time
        FROM v_snipe WHERE is_active
        UNION ALL
        SELECT f.auction_id, o.rn,
               f.extensions + CASE WHEN o.created_at < f.end_time
                                    AND o.created_at >= f.end_time - INTERVAL 60 SECOND THEN 1 ELSE 0 END,
               f.end_time + CASE WHEN o.created_at < f.end_time
                                  AND o.created_at >= f.end_time - INTERVAL 60 SECOND
                                 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END
        FROM fold f JOIN ordered o ON o.auction_id = f.auction_id AND o.rn = f.rn + 1)
    SELECT auction_id, extensions, end_time
    FROM (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY rn DESC) AS last FROM fold) x
    WHERE last = 1
"""


@query("extended_end_time", _EXTENDED)
def extended_end_time(m: Marketplace) -> DataFrame:
    return auctions.extended_end_times(m["v_snipe"], m["v_bids"])


def _cooldown_sql(source: str, minutes: int) -> str:
    return f"""
    WITH RECURSIVE ordered AS (
        SELECT user_id, sent_at, row_number() OVER (PARTITION BY user_id ORDER BY sent_at, id) AS rn FROM {source}),
    fold AS (
        SELECT user_id, rn, sent_at, sent_at AS last, TRUE AS sends FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.rn, o.sent_at,
               CASE WHEN o.sent_at > f.last + INTERVAL {minutes} MINUTE THEN o.sent_at ELSE f.last END,
               o.sent_at > f.last + INTERVAL {minutes} MINUTE
        FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
    SELECT user_id, sent_at FROM fold WHERE sends
    """


@query("mail_after_cooldown", _cooldown_sql("v_new_messages", 120))
def mail_after_cooldown(m: Marketplace) -> DataFrame:
    return notify.mail_after_cooldown(m["v_new_messages"])


# ---- set operations ---------------------------------------------------------------------


@query("orphaned_images", """
    SELECT post_id, image_url, regexp_extract(image_url, '^http://[^/]+/(.*)$', 1) AS storage_key
    FROM v_image_edits o
    WHERE NOT EXISTS (SELECT 1 FROM v_image_edits n
                      WHERE n.kept AND n.post_id = o.post_id AND n.image_url = o.image_url)
""")
def orphaned_images(m: Marketplace) -> DataFrame:
    edits = m["v_image_edits"]
    return listings.orphaned_images(edits.select("post_id", "image_url"), edits.where("kept"))


_WON = """
    SELECT t.user_id, a.id AS auction_id, 'won' AS type, :as_of AS created_at
    FROM v_auctions a
    JOIN (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY bid_amount DESC, created_at, id) AS rn
          FROM v_bids) t ON t.auction_id = a.id AND t.rn = 1
    WHERE a.is_active AND a.end_time <= :as_of
"""


@query("notification_feed", f"""
    {_WON}
    UNION ALL
    SELECT loser, auction_id, 'outbid', created_at
    FROM (SELECT *, lag(user_id) OVER (PARTITION BY auction_id ORDER BY created_at, id) AS loser
          FROM ({_JUDGED}) j WHERE prior_amount IS NULL OR bid_amount > prior_amount) b
    WHERE loser IS NOT NULL AND loser <> user_id
""")
def notification_feed(m: Marketplace) -> DataFrame:
    results = closing.expired_results(m["v_auctions"], m["v_bids"], None, AS_OF)
    return notify.notification_feed(
        closing.won_notifications(results, AS_OF), auctions.outbid_notices(m["v_bids"])
    )


@query("image_rows", """
    SELECT post_id, CAST(i - 1 AS INTEGER) AS position, image_urls[i] AS image_url,
           regexp_extract(image_urls[i], '([^/]*)$', 1) AS public_id
    FROM (SELECT id AS post_id, image_urls, unnest(generate_series(1, len(image_urls))) AS i FROM v_auctions) x
""")
def image_rows(m: Marketplace) -> DataFrame:
    return listings.image_rows(m["v_auctions"].withColumnRenamed("id", "post_id"))


# ---- state transitions ------------------------------------------------------------------


@query("append_with_defaults", """
    SELECT id, user_id, address_line1, city, state, postal_code, 'US' AS country_code, created_at FROM v_addresses
    UNION ALL
    SELECT (SELECT max(id) FROM v_addresses) + row_number() OVER (ORDER BY user_id), user_id,
           'care of ' || first_name, NULL, NULL, NULL, 'US', :as_of
    FROM v_profiles
""")
def append_with_defaults(m: Marketplace) -> DataFrame:
    current = m["v_addresses"].withColumn("country_code", F.lit("US"))
    new = m["v_profiles"].select(
        "user_id", F.concat(F.lit("care of "), "first_name").alias("address_line1")
    )
    return changes.append(current, new, "addresses", ["user_id"], AS_OF)


@query("patch_auctions", """
    SELECT a.id, coalesce(c.title, a.title) AS title, a.description,
           coalesce(c.start_price, a.start_price) AS start_price, a.buy_now_price, a.end_time,
           coalesce(c.is_active, a.is_active) AS is_active,
           CASE WHEN c.id IS NOT NULL THEN 1 ELSE a.creator_id END AS creator_id,
           array_to_string(a.image_urls, ',') AS image_urls
    FROM v_auctions a LEFT JOIN v_auction_changes c ON c.id = a.id
""")
def patch_auctions(m: Marketplace) -> DataFrame:
    patched = changes.patch(
        m["v_auctions"], m["v_auction_changes"],
        always={"creator_id": F.lit(ADMIN_ID).cast("bigint")},
    )
    return patched.withColumn("image_urls", F.array_join("image_urls", ","))


@query("overwrite_profiles", """
    SELECT p.user_id,
           CASE WHEN c.user_id IS NULL THEN p.first_name ELSE c.first_name END AS first_name,
           CASE WHEN c.user_id IS NULL THEN p.last_name ELSE c.last_name END AS last_name,
           CASE WHEN c.user_id IS NULL THEN p.send_email_notifications
                ELSE c.send_email_notifications END AS send_email_notifications,
           p.last_auction_email_at, p.last_message_email_at, p.created_at
    FROM v_profiles p LEFT JOIN v_profile_changes c ON c.user_id = p.user_id
""")
def overwrite_profiles(m: Marketplace) -> DataFrame:
    return changes.overwrite(m["v_profiles"], m["v_profile_changes"], "user_id")


@query("upsert_profiles", """
    SELECT coalesce(p.user_id, c.user_id) AS user_id,
           CASE WHEN c.user_id IS NULL THEN p.first_name ELSE c.first_name END AS first_name,
           CASE WHEN c.user_id IS NULL THEN p.last_name ELSE c.last_name END AS last_name,
           CASE WHEN c.user_id IS NULL THEN p.send_email_notifications
                ELSE c.send_email_notifications END AS send_email_notifications,
           p.last_auction_email_at, p.last_message_email_at,
           CASE WHEN p.user_id IS NULL THEN :as_of ELSE p.created_at END AS created_at
    FROM v_profiles p FULL OUTER JOIN v_profile_changes c ON c.user_id = p.user_id
""")
def upsert_profiles(m: Marketplace) -> DataFrame:
    return changes.upsert(m["v_profiles"], m["v_profile_changes"], "profiles", AS_OF)


@query("upsert_addresses", """
    WITH newest AS (
        SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
                                 FROM v_addresses) a WHERE rn = 1),
    hit AS (SELECT n.id AS hit_id, c.* FROM newest n JOIN v_address_changes c ON c.user_id = n.user_id)
    SELECT a.id, a.user_id,
           CASE WHEN h.hit_id IS NULL THEN a.address_line1 ELSE h.address_line1 END AS address_line1,
           CASE WHEN h.hit_id IS NULL THEN a.city ELSE h.city END AS city,
           CASE WHEN h.hit_id IS NULL THEN a.state ELSE h.state END AS state,
           CASE WHEN h.hit_id IS NULL THEN a.postal_code ELSE h.postal_code END AS postal_code,
           'US' AS country_code, a.created_at
    FROM v_addresses a LEFT JOIN hit h ON h.hit_id = a.id
    UNION ALL
    SELECT (SELECT max(id) FROM v_addresses) + row_number() OVER (ORDER BY c.user_id), c.user_id,
           c.address_line1, c.city, c.state, c.postal_code, 'US', :as_of
    FROM v_address_changes c WHERE c.user_id NOT IN (SELECT user_id FROM newest)
""")
def upsert_addresses(m: Marketplace) -> DataFrame:
    current = m["v_addresses"].withColumn("country_code", F.lit("US"))
    return changes.upsert_addresses(current, m["v_address_changes"], AS_OF)


@query("cascade_delete", """
    SELECT 'auctions' AS kept_in, id FROM v_auctions WHERE is_active
    UNION ALL SELECT 'bids', id FROM v_bids WHERE auction_id NOT IN (SELECT id FROM v_auctions WHERE NOT is_active)
    UNION ALL SELECT 'notifications', id FROM v_notifications
              WHERE auction_id NOT IN (SELECT id FROM v_auctions WHERE NOT is_active)
    UNION ALL SELECT 'auction_results', id FROM v_results
              WHERE auction_id NOT IN (SELECT id FROM v_auctions WHERE NOT is_active)
""")
def cascade_delete(m: Marketplace) -> DataFrame:
    tables = {
        "auctions": m["v_auctions"], "bids": m["v_bids"],
        "notifications": m["v_notifications"], "auction_results": m["v_results"],
    }
    closed = m["v_auctions"].where(~F.col("is_active")).select("id")
    kept = changes.delete(tables, "auctions", closed, also={"auction_results": "auction_id"})
    parts = [rows.select(F.lit(name).alias("kept_in"), "id") for name, rows in kept.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("soft_delete", """
    SELECT id, title, price, hide,
           CASE WHEN id NOT IN (SELECT post_id FROM v_sales) THEN TRUE ELSE is_deleted END AS is_deleted,
           CASE WHEN id NOT IN (SELECT post_id FROM v_sales) THEN :as_of END AS deleted_at
    FROM v_posts
""")
def soft_delete(m: Marketplace) -> DataFrame:
    unsold = listings.missing(m["v_sales"].select(F.col("post_id").alias("id")), m["v_posts"].select("id"))
    return changes.soft_delete(m["v_posts"], unsold, AS_OF).select(
        "id", "title", "price", "hide", "is_deleted", "deleted_at"
    )


_PAID = "SELECT id, created_at < TIMESTAMP '1998-01-01 00:00:00' AS is_paid FROM v_sales WHERE NOT is_paid"


@query("mark_paid", f"""
    SELECT s.id, s.post_id, s.buyer_id, s.price, coalesce(c.is_paid, s.is_paid) AS is_paid, s.created_at,
           CASE WHEN c.is_paid THEN :as_of END AS paid_at
    FROM v_sales s LEFT JOIN ({_PAID}) c ON c.id = s.id
""", money=("price",))
def mark_paid(m: Marketplace) -> DataFrame:
    return changes.mark_paid(m["v_sales"], m.sql(_PAID), AS_OF)


@query("mark_result_paid", """
    SELECT id, auction_id, winner_id, final_bid, winner_id IS NOT NULL AS is_paid FROM v_results
""")
def mark_result_paid(m: Marketplace) -> DataFrame:
    paid = m["v_results"].select("auction_id", F.col("winner_id").isNotNull().alias("is_paid"))
    return changes.mark_result_paid(m["v_results"], paid).select(
        "id", "auction_id", "winner_id", "final_bid", "is_paid"
    )


@query("mark_read", """
    SELECT id, conversation_id, user_id, CASE WHEN NOT is_from_admin THEN TRUE ELSE is_read END AS is_read,
           is_from_admin
    FROM v_messages
""")
def mark_read(m: Marketplace) -> DataFrame:
    seen = m["v_messages"].where(~F.col("is_from_admin")).select("id")
    return changes.mark_messages_read(m["v_messages"], seen).select(
        "id", "conversation_id", "user_id", "is_read", "is_from_admin"
    )


@query("mark_notifications_read", """
    SELECT id, user_id, auction_id, type, created_at,
           is_read OR user_id IN (SELECT id FROM v_users WHERE is_verified) AS is_read
    FROM v_notifications
""")
def mark_notifications_read(m: Marketplace) -> DataFrame:
    readers = m["v_users"].where("is_verified").select("id")
    return changes.mark_notifications_read(m["v_notifications"], readers)


_EXPIRED = """
    SELECT a.id AS auction_id, t.user_id AS winner_id, t.bid_amount AS final_bid, :as_of AS closed_at,
           'expired' AS closed_reason, FALSE AS is_paid
    FROM v_auctions a
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY bid_amount DESC, created_at, id) AS rn
               FROM v_bids) t ON t.auction_id = a.id AND t.rn = 1
    WHERE a.is_active AND a.end_time <= :as_of
"""


def _closing(m: Marketplace) -> closing.Closing:
    return closing.close_expired(m["v_auctions"], m["v_bids"], m["v_messages"], AS_OF, m["v_results"])


@query("close_expired_auctions", f"""
    {_EXPIRED} AND a.id NOT IN (SELECT auction_id FROM v_results)
""")
def close_expired_auctions(m: Marketplace) -> DataFrame:
    return closing.expired_results(m["v_auctions"], m["v_bids"], m["v_results"], AS_OF)


@query("close_expired_snapshot", """
    SELECT id, title, end_time, is_active AND end_time > :as_of AS is_active FROM v_auctions
""")
def close_expired_snapshot(m: Marketplace) -> DataFrame:
    due = closing.due_auctions(m["v_auctions"], m["v_results"], AS_OF)
    return closing.deactivate(m["v_auctions"], due, AS_OF).select("id", "title", "end_time", "is_active")


@query("close_expired_notifications", _WON)
def close_expired_notifications(m: Marketplace) -> DataFrame:
    results = closing.expired_results(m["v_auctions"], m["v_bids"], m["v_results"], AS_OF)
    return closing.won_notifications(results, AS_OF).drop("is_read")


_PLACED_WINS = """
    SELECT w.auction_id, w.user_id, coalesce(k.conversation_id, n.conversation_id) AS conversation_id,
           :as_of AS sent_at, TRUE AS is_from_admin
    FROM wins w LEFT JOIN known k ON k.user_id = w.user_id LEFT JOIN fresh n ON n.user_id = w.user_id
"""
_FRESH = """
    SELECT user_id, (SELECT coalesce(max(conversation_id), 0) FROM v_messages)
                    + row_number() OVER (ORDER BY user_id) AS conversation_id
    FROM (SELECT DISTINCT user_id FROM wins WHERE user_id NOT IN (SELECT user_id FROM known)) x
"""


@query("close_expired_messages", f"""
    WITH wins AS ({_WON}), known AS ({_FIRST_CONVERSATION}), fresh AS ({_FRESH})
    {_PLACED_WINS}
""")
def close_expired_messages(m: Marketplace) -> DataFrame:
    return _closing(m).messages.select(
        "auction_id", "user_id", "conversation_id", "sent_at", "is_from_admin"
    )


_BOUGHT = """
    SELECT a.id AS auction_id, r.user_id, a.buy_now_price AS bid_amount, r.created_at
    FROM v_auctions a
    JOIN (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY created_at, id) AS rn FROM v_buy_now) r
      ON r.auction_id = a.id AND r.rn = 1
    WHERE a.is_active AND a.buy_now_price > 0
"""


def _buying(m: Marketplace) -> closing.Closing:
    return closing.buy_now(m["v_auctions"], m["v_buy_now"], m["v_messages"], AS_OF, m["v_results"])


@query("buy_now_close", f"""
    SELECT auction_id, user_id AS winner_id, bid_amount AS final_bid, created_at AS closed_at,
           'buy_now' AS closed_reason, FALSE AS is_paid
    FROM ({_BOUGHT}) b
""")
def buy_now_close(m: Marketplace) -> DataFrame:
    return closing.buy_now_results(closing.buy_now_sales(m["v_auctions"], m["v_buy_now"], m["v_results"]))


@query("buy_now_bids", _BOUGHT)
def buy_now_bids(m: Marketplace) -> DataFrame:
    return closing.buy_now_sales(m["v_auctions"], m["v_buy_now"], m["v_results"])


@query("buy_now_snapshot", f"""
    SELECT id, end_time, is_active AND id NOT IN (SELECT auction_id FROM ({_BOUGHT}) b) AS is_active FROM v_auctions
""")
def buy_now_snapshot(m: Marketplace) -> DataFrame:
    sold = closing.buy_now_sales(m["v_auctions"], m["v_buy_now"], m["v_results"])
    return closing.deactivate(m["v_auctions"], sold, AS_OF).select("id", "end_time", "is_active")


@query("buy_now_messages", f"""
    WITH wins AS ({_BOUGHT}),
    known AS (SELECT user_id, max(conversation_id) AS conversation_id FROM v_messages GROUP BY user_id),
    fresh AS ({_FRESH})
    {_PLACED_WINS}
""")
def buy_now_messages(m: Marketplace) -> DataFrame:
    return _buying(m).messages.select(
        "auction_id", "user_id", "conversation_id", "sent_at", "is_from_admin"
    )


def _sales(m: Marketplace) -> tuple[DataFrame, DataFrame, DataFrame]:
    return trade.record_sales(m["v_sale_input"], m["v_users"], m["v_posts"], AS_OF)


_GOOD_SALES = """
    SELECT s.id AS request_id, s.post_id, u.id AS buyer_id, s.price
    FROM v_sale_input s JOIN v_users u ON u.email = s.buyer_email
    WHERE coalesce(s.post_id, 0) <> 0 AND coalesce(s.price, 0) <> 0
"""


@query("record_sales", f"""
    SELECT *, CAST(NULL AS VARCHAR) AS tracking_number, FALSE AS is_paid, :as_of AS created_at FROM ({_GOOD_SALES}) g
""", money=("price",))
def record_sales(m: Marketplace) -> DataFrame:
    return _sales(m)[0]


@query("record_sales_listings", f"""
    SELECT id, title, sold OR id IN (SELECT post_id FROM ({_GOOD_SALES}) g) AS sold FROM v_posts
""")
def record_sales_listings(m: Marketplace) -> DataFrame:
    return _sales(m)[1].select("id", "title", "sold")


@query("record_sales_rejects", """
    SELECT id, CASE WHEN failed <> '' THEN failed ELSE 'buyer not found' END AS reason
    FROM (SELECT s.id, u.id AS buyer_id,
                 concat_ws('; ', CASE WHEN coalesce(s.buyer_email, '') = '' THEN 'buyer_email is required' END,
                           CASE WHEN coalesce(s.post_id, 0) = 0 THEN 'post_id is required' END,
                           CASE WHEN coalesce(s.price, 0) = 0 THEN 'price is required' END) AS failed
          FROM v_sale_input s LEFT JOIN v_users u ON u.email = s.buyer_email) x
    WHERE failed <> '' OR buyer_id IS NULL
""")
def record_sales_rejects(m: Marketplace) -> DataFrame:
    return _sales(m)[2]


@query("apply_discount", rf"""
    SELECT id, price, author_id,
           CASE WHEN author_id = 1 THEN price END AS original_price,
           CASE WHEN author_id = 1
                THEN CAST(TRY_CAST(regexp_extract(price, '^\s*([+-]?[0-9]+(\.[0-9]*)?)', 1) AS DECIMAL(18,4))
                          * (100 - {DISCOUNT}) / 100 AS DECIMAL(18,4)) END AS discounted_price
    FROM v_posts
""", money=("discounted_price",))
def apply_discount(m: Marketplace) -> DataFrame:
    return trade.apply_discount(m["v_posts"], 1, DISCOUNT).select(
        "id", "price", "author_id", "original_price", "discounted_price"
    )


@query("undo_discount", """
    SELECT id, price, author_id, CASE WHEN author_id <> 1 THEN price END AS original_price,
           CASE WHEN author_id <> 1 THEN TRY_CAST(price AS DECIMAL(18,4)) END AS discounted_price
    FROM v_posts
""", money=("discounted_price",))
def undo_discount(m: Marketplace) -> DataFrame:
    discounted = m["v_posts"].withColumns({"original_price": F.col("price"), "discounted_price": F.col("price")})
    return trade.undo_discount(discounted, 1).select(
        "id", "price", "author_id", "original_price", "discounted_price"
    )


_SWAPPED = """
    SELECT (SELECT max(id) FROM v_posts) + row_number() OVER (ORDER BY id) AS id, id AS auction_id, title, description,
           image_urls, coalesce(nullif(buy_now_price, 0), start_price) AS price, creator_id
    FROM v_auctions
"""


@query("swap_to_listing", f"""
    SELECT id, auction_id, title, description, image_urls[1] AS image_url, CAST(price AS VARCHAR) AS price,
           creator_id AS author_id, regexp_extract(image_urls[1], '([^/]*)$', 1) AS public_id,
           len(image_urls) AS num_imgs, FALSE AS sold, FALSE AS hide, :as_of AS created_at
    FROM ({_SWAPPED}) s
""")
def swap_to_listing(m: Marketplace) -> DataFrame:
    return trade.swap_to_listings(m["v_auctions"], m["v_posts"], AS_OF).drop("category", "is_deleted")


@query("swap_images", f"""
    SELECT post_id, CAST(i - 1 AS INTEGER) AS position, image_urls[i] AS image_url,
           regexp_extract(image_urls[i], '([^/]*)$', 1) AS public_id
    FROM (SELECT id AS post_id, image_urls, unnest(generate_series(1, len(image_urls))) AS i
          FROM ({_SWAPPED}) s) x
""")
def swap_images(m: Marketplace) -> DataFrame:
    new = trade.swap_to_listings(m["v_auctions"], m["v_posts"], AS_OF)
    return trade.swap_images(m["v_auctions"], new)


@query("assign_conversations", f"""
    WITH known AS ({_FIRST_CONVERSATION}),
    fresh AS (SELECT user_id, (SELECT coalesce(max(conversation_id), 0) FROM v_messages)
                              + row_number() OVER (ORDER BY since, user_id) AS conversation_id
              FROM (SELECT user_id, min(sent_at) AS since FROM v_new_messages
                    WHERE user_id NOT IN (SELECT user_id FROM known) GROUP BY user_id) x)
    SELECT w.id, w.user_id, w.sent_at, coalesce(k.conversation_id, n.conversation_id) AS conversation_id
    FROM v_new_messages w LEFT JOIN known k ON k.user_id = w.user_id LEFT JOIN fresh n ON n.user_id = w.user_id
""")
def assign_conversations(m: Marketplace) -> DataFrame:
    return conversations.assign(m["v_new_messages"], m["v_messages"])


@query("purge_notifications", f"""
    SELECT * FROM v_notifications WHERE NOT created_at < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 30 DAY
""")
def purge_notifications(m: Marketplace) -> DataFrame:
    return changes.purge_notifications(m["v_notifications"], PURGE_AS_OF)


@query("touch_mail_times", """
    SELECT user_id, CASE WHEN send_email_notifications AND user_id % 9 <> 0 THEN :as_of
                         ELSE last_auction_email_at END AS last_auction_email_at
    FROM v_profiles
""")
def touch_mail_times(m: Marketplace) -> DataFrame:
    return changes.touch_mail_times(m["v_profiles"], _outcomes(m), AS_OF).select(
        "user_id", "last_auction_email_at"
    )


def _stored(m: Marketplace, table: str, view: str) -> PartitionedTables:
    """A view stored as a partitioned table, for changes in place."""
    store = PartitionedTables(m.spark, scratch_path(m.spark, "tables"))
    rows = empty_table(m.spark, table).unionByName(m[view], allowMissingColumns=True)
    store.append(table, rows.select(empty_table(m.spark, table).columns))
    return store


@query("stored_mark_read", """
    SELECT id, conversation_id, user_id, CASE WHEN id % 700 = 1 THEN TRUE ELSE is_read END AS is_read, is_from_admin FROM v_messages
""")
def stored_mark_read(m: Marketplace) -> DataFrame:
    store = _stored(m, "messages", "v_messages")
    stored.mark_messages_read(store, m["v_messages"].where("id % 700 = 1").select("id"))
    return store.read("messages").select("id", "conversation_id", "user_id", "is_read", "is_from_admin")


@query("stored_purge", f"""
    SELECT * FROM v_notifications WHERE NOT created_at < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 30 DAY
""")
def stored_purge(m: Marketplace) -> DataFrame:
    store = _stored(m, "notifications", "v_notifications")
    stored.purge_notifications(store, PURGE_AS_OF)
    return store.read("notifications").select(m["v_notifications"].columns)


@query("stored_delete", "SELECT id, user_id, address_line1, city, state, postal_code, created_at FROM v_addresses WHERE user_id % 50 <> 3")
def stored_delete(m: Marketplace) -> DataFrame:
    store = _stored(m, "addresses", "v_addresses")
    stored.delete(store, "addresses", m["v_addresses"].where("user_id % 50 = 3").select("id"))
    return store.read("addresses").select(m["v_addresses"].columns)


# ---- outbox -----------------------------------------------------------------------------


@query("outbox_auction", f"""
    SELECT p.user_id, u.email AS to_address, 'New Auction Posted: ' || a.title AS subject, a.title, a.description,
           a.image_urls[1] AS image_url, '{notify.SITE}/auctions/' || CAST(a.id AS VARCHAR) AS item_url,
           '{notify.SITE}' AS home_url
    FROM v_profiles p JOIN v_users u ON p.user_id = u.id,
         (SELECT * FROM v_auctions ORDER BY id DESC LIMIT 1) a
    WHERE p.send_email_notifications
      AND (p.last_auction_email_at IS NULL OR p.last_auction_email_at < :as_of - INTERVAL 120 MINUTE)
""")
def outbox_auction(m: Marketplace) -> DataFrame:
    recipients = notify.item_mail_recipients(m["v_profiles"], m["v_users"], AS_OF)
    return notify.auction_outbox(recipients, m["v_auctions"])


@query("outbox_post", f"""
    SELECT p.user_id, u.email AS to_address, 'New Gallery Post: ' || a.title AS subject, a.title, a.description,
           coalesce(a.image_url, '') AS image_url, '{notify.SITE}/' || CAST(a.id AS VARCHAR) AS item_url,
           '{notify.SITE}' AS home_url
    FROM v_profiles p JOIN v_users u ON p.user_id = u.id, (SELECT * FROM v_posts ORDER BY id DESC LIMIT 1) a
    WHERE p.send_email_notifications
      AND (p.last_message_email_at IS NULL OR p.last_message_email_at < TIMESTAMP '2024-01-16 01:30:00' - INTERVAL 120 MINUTE)
""")
def outbox_post(m: Marketplace) -> DataFrame:
    recipients = notify.item_mail_recipients(
        _post_mail_profiles(m), m["v_users"], "2024-01-16 01:30:00", "last_post_email_at"
    )
    return notify.listing_outbox(recipients, m["v_posts"])


@query("outbox_tracking", f"""
    SELECT 'sale' AS kind, s.id AS sale_id, u.email AS to_address, 'Your package has shipped!' AS subject,
           'RA ' || CAST(s.id AS VARCHAR) || '/US (' || s.post_id || ')' AS tracking_number,
           '{text.TRACKING_URL}RA%20' || CAST(s.id AS VARCHAR) || '%2FUS%20(' || s.post_id || ')' AS tracking_url,
           '{notify.SITE}' AS home_url
    FROM v_sales s JOIN v_users u ON u.id = s.buyer_id WHERE s.is_paid
""")
def outbox_tracking(m: Marketplace) -> DataFrame:
    number = F.concat(
        F.lit("RA "), F.col("id").cast("string"), F.lit("/US ("), F.col("post_id").cast("string"), F.lit(")")
    )
    shipped = m["v_sales"].withColumn("tracking_number", F.when(F.col("is_paid"), number))
    return notify.tracking_outbox(shipped, m["v_users"])


_PREVIEW = """
    CASE WHEN length(message_content) > 200
         THEN regexp_replace(substr(message_content, 1, 200), '\\s+$', '') || '…' ELSE message_content END
"""


def _escaped(sql: str) -> str:
    for raw, entity in text.HTML_ENTITIES:
        quoted = raw.replace("'", "''")
        sql = f"replace({sql}, '{quoted}', '{entity}')"
    return sql


_HTML = f"regexp_replace({_escaped(_PREVIEW)}, '\\r\\n|\\r|\\n', '<br />', 'g')"


@query("outbox_message", f"""
    SELECT m.id AS message_id, m.recipient_id, u.email AS to_address, 'You have a new message' AS subject,
           CASE WHEN m.message_content = '' THEN 'Open your inbox to view the message.' ELSE {_HTML} END AS preview_html,
           '{notify.SITE}/messages' AS inbox_url
    FROM (SELECT v.id, v.message_content,
                 CASE WHEN v.is_from_admin THEN coalesce(r.recipient_id, v.user_id) ELSE {ADMIN_ID} END AS recipient_id
          FROM v_messages v LEFT JOIN ({_REPLY_RECIPIENT}) r ON r.conversation_id = v.conversation_id) m
    JOIN v_users u ON u.id = m.recipient_id
    JOIN v_profiles p ON p.user_id = m.recipient_id
    WHERE p.send_email_notifications
      AND (m.recipient_id = {ADMIN_ID} OR p.last_message_email_at IS NULL
           OR p.last_message_email_at <= :as_of - INTERVAL 20 MINUTE)
""")
def outbox_message(m: Marketplace) -> DataFrame:
    routed = messaging.route(m["v_messages"], messaging.reply_recipient(m["v_messages"]), ADMIN_ID)
    decided = notify.message_mail_decision(routed, m["v_profiles"], AS_OF, ADMIN_ID, "recipient_id")
    return notify.message_outbox(decided, m["v_users"])


@query("outbox_broadcast", f"""
    SELECT p.user_id, u.email AS to_address, 'Spring & summer hours' AS subject,
           'Spring &amp; summer hours' AS subject_html,
           'We are open &quot;late&quot;.<br />See &lt;you&gt; &amp; yours soon' AS body_html,
           '{notify.SITE}' AS home_url
    FROM v_profiles p JOIN v_users u ON u.id = p.user_id WHERE p.send_email_notifications
""")
def outbox_broadcast(m: Marketplace) -> DataFrame:
    return notify.broadcast_outbox(notify.opted_in(m["v_profiles"], m["v_users"]), *BROADCAST)


# ---- functions --------------------------------------------------------------------------


@query("text_functions", f"""
    SELECT id, {_PREVIEW} AS preview, {_escaped("message_content")} AS escaped, {_HTML} AS preview_html,
           regexp_replace(message_content, '^\\s+|\\s+$', '', 'g') AS trimmed,
           'Re: ' || message_content || ' (' || CAST(conversation_id AS VARCHAR) || ')' AS filled,
           regexp_full_match(message_content, '[0-9]+') AS is_digits
    FROM v_messages
""")
def text_functions(m: Marketplace) -> DataFrame:
    body = F.col("message_content")
    return m["v_messages"].select(
        "id", text.preview(body).alias("preview"), text.escape_html(body).alias("escaped"),
        text.html_body(text.preview(body)).alias("preview_html"), text.trimmed(body).alias("trimmed"),
        text.fill("Re: {{body}} ({{talk}})", {"body": body, "talk": F.col("conversation_id")}).alias("filled"),
        text.is_digits(body).alias("is_digits"),
    )


@query("url_functions", r"""
    SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS url_key,
           regexp_extract(url, '([^/]*)$', 1) AS url_tail,
           replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'),
                   '%2A', '*') AS encoded
    FROM pages
""")
def url_functions(m: Marketplace) -> DataFrame:
    url = F.col("url")
    return m["pages"].select(
        "page_id", text.url_key(url).alias("url_key"), text.url_tail(url).alias("url_tail"),
        text.percent_encoded(url).alias("encoded"),
    )


@query("decrypt_messages", """
    SELECT id, conversation_id, message_content, TRUE AS is_readable FROM v_messages
""")
def decrypt_messages(m: Marketplace) -> DataFrame:
    stored = messaging.encrypt_messages(m["v_messages"], SECRET)
    return messaging.decrypt_messages(stored, SECRET).select(
        "id", "conversation_id", "message_content", "is_readable"
    )


@query("decrypt_foreign_messages", """
    SELECT id, CAST(NULL AS VARCHAR) AS message_content, FALSE AS is_readable FROM v_messages
""")
def decrypt_foreign_messages(m: Marketplace) -> DataFrame:
    """Plain text and text sealed with another key are not readable, and do not fail the job."""
    plain = m["v_messages"].withColumn("_plain", F.col("message_content"))
    mixed = messaging.encrypt_messages(plain, "another secret").withColumn(
        "message_content", F.when(F.col("is_from_admin"), F.col("_plain")).otherwise(F.col("message_content"))
    )
    return messaging.decrypt_messages(mixed, SECRET).select("id", "message_content", "is_readable")


@query("event_fanout", """
    SELECT id, event_name, 'everyone' AS target FROM v_live_events WHERE event_name = 'bid-placed'
    UNION ALL SELECT id, event_name, 'user_' || user_id FROM v_live_events
              WHERE event_name IN ('user-outbid', 'sale-created') AND user_id IS NOT NULL
    UNION ALL SELECT id, event_name, 'admin_room' FROM v_live_events
              WHERE event_name = 'sale-created' AND user_id IS NOT NULL
    UNION ALL SELECT id, event_name, 'conversation_' || conversation_id FROM v_live_events
              WHERE event_name = 'new_message' AND conversation_id IS NOT NULL
    UNION ALL SELECT id, event_name, 'admin_room' FROM v_live_events
              WHERE event_name = 'new_customer_message' AND NOT is_from_admin
""")
def event_fanout(m: Marketplace) -> DataFrame:
    return fanout.fan_out(m["v_live_events"]).select("id", "event_name", "target")


# ---- streaming jobs, replayed over the stored events ------------------------------------


@query("stream_bids", f"""
    SELECT id, auction_id, user_id, bid_amount, created_at,
           CASE WHEN loser <> user_id THEN loser END AS outbid_user_id
    FROM (SELECT *, lag(user_id) OVER (PARTITION BY auction_id ORDER BY created_at, id) AS loser
          FROM ({_JUDGED}) j WHERE prior_amount IS NULL OR bid_amount > prior_amount) a
""")
def stream_bids(m: Marketplace) -> DataFrame:
    return replay(live_bids.accept_bids(m.stream("events")["v_bids"]), "bids")


# ends that the watermark (newest bid minus ten minutes) has passed
_STREAM_CLOSE = f"""
    SELECT e.auction_id, e.extensions, e.end_time, t.user_id, t.bid_amount, t.id AS bid_id, 'expired' AS reason,
           'result' AS kind
    FROM ({_EXTENDED}) e
    JOIN (SELECT b.*, row_number() OVER (PARTITION BY b.auction_id ORDER BY b.bid_amount DESC, b.created_at, b.id) AS rn
          FROM v_bids b JOIN ({_EXTENDED}) x ON x.auction_id = b.auction_id AND b.created_at < x.end_time) t
      ON t.auction_id = e.auction_id AND t.rn = 1
    WHERE e.end_time < (SELECT max(created_at) FROM v_bids) - INTERVAL 10 MINUTE
    UNION ALL
    SELECT b.auction_id, NULL, NULL, b.user_id, b.bid_amount, b.id, 
           CASE WHEN x.auction_id IS NULL THEN 'unknown auction' ELSE 'after the end' END, 'dead-letter'
    FROM v_bids b LEFT JOIN ({_EXTENDED}) x ON x.auction_id = b.auction_id
    WHERE x.auction_id IS NULL OR b.created_at >= x.end_time
"""


@query("stream_auction_close", _STREAM_CLOSE)
def stream_auction_close(m: Marketplace) -> DataFrame:
    # every second auction opens while the stream runs
    later = m["v_snipe"].where("id % 2 = 1").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    path = scratch_path(m.spark, "openings")
    later.write.parquet(path)
    openings = m.spark.readStream.schema(later.schema).parquet(path)
    known = m["v_snipe"].where("id % 2 = 0")
    return replay(live_closing.close_auctions(m.stream("events")["v_bids"], known, openings=openings), "close")


# one bid at a time, in the order of its arrival; a bid finds its auction closed once the watermark of its delivery has passed the end
_FLOOR = """
    WITH RECURSIVE marks AS (
        SELECT d.delivery, (SELECT max(created_at) FROM v_arrivals b WHERE b.delivery < d.delivery) - INTERVAL 10 MINUTE AS passed
        FROM (SELECT DISTINCT delivery FROM v_arrivals) d),
    ordered AS (
        SELECT a.*, passed, row_number() OVER (PARTITION BY auction_id ORDER BY a.delivery, created_at, id) AS rn
        FROM v_arrivals a JOIN marks ON marks.delivery = a.delivery),
    judged AS (
        SELECT o.*, end_time AS old_end, CAST(NULL AS INTEGER) AS high, CAST(NULL AS BIGINT) AS holder,
               created_at < end_time AND coalesce(end_time >= passed, TRUE) AS running, TRUE AS higher
        FROM ordered o JOIN v_snipe s ON s.id = o.auction_id WHERE rn = 1
        UNION ALL
        SELECT o.id, o.auction_id, o.user_id, o.bid_amount, o.created_at, o.delivery, o.passed, o.rn, n.new_end, n.new_high, n.new_holder,
               o.created_at < n.new_end AND coalesce(n.new_end >= o.passed, TRUE), n.new_high IS NULL OR o.bid_amount > n.new_high
        FROM (SELECT auction_id, rn,
                     CASE WHEN running AND higher AND created_at >= old_end - INTERVAL 60 SECOND THEN old_end + INTERVAL 5 MINUTE ELSE old_end END AS new_end,
                     CASE WHEN running AND higher THEN bid_amount ELSE high END AS new_high,
                     CASE WHEN running AND higher THEN user_id ELSE holder END AS new_holder
              FROM judged) n
        JOIN ordered o ON o.auction_id = n.auction_id AND o.rn = n.rn + 1),
    placed AS (
        SELECT *, created_at >= old_end - INTERVAL 60 SECOND AS extends FROM judged WHERE running AND higher),
    last AS (
        SELECT s.id AS auction_id, coalesce(max(old_end + CASE WHEN extends THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END), any_value(s.end_time)) AS end_time,
               max(bid_amount) AS bid_amount, max_by(p.id, bid_amount) AS bid_id, max_by(user_id, bid_amount) AS user_id
        FROM v_snipe s LEFT JOIN placed p ON p.auction_id = s.id GROUP BY s.id),
    ended AS (SELECT * FROM last WHERE end_time < (SELECT max(created_at) FROM v_arrivals) - INTERVAL 10 MINUTE)
    SELECT 'bid-placed' AS event_name, auction_id, user_id, id AS bid_id, bid_amount, CAST(NULL AS TIMESTAMP) AS end_time, created_at AS event_at, CAST(NULL AS VARCHAR) AS reason
    FROM placed
    UNION ALL SELECT 'user-outbid', auction_id, holder, id, bid_amount, NULL, created_at, NULL FROM placed WHERE holder <> user_id
    UNION ALL SELECT 'auction-extended', auction_id, user_id, id, bid_amount, old_end + INTERVAL 5 MINUTE, created_at, NULL FROM placed WHERE extends
    UNION ALL SELECT 'bid-rejected', auction_id, user_id, id, bid_amount, NULL, created_at, CASE WHEN running THEN 'not higher than the current bid' ELSE 'after the end' END
    FROM judged WHERE NOT (running AND higher)
    UNION ALL SELECT 'bid-rejected', auction_id, user_id, id, bid_amount, NULL, created_at, 'unknown auction'
    FROM v_arrivals WHERE auction_id NOT IN (SELECT id FROM v_snipe)
    UNION ALL SELECT 'auction-ended', auction_id, user_id, bid_id, bid_amount, end_time, end_time, 'expired' FROM ended
    UNION ALL SELECT 'user-won', auction_id, user_id, bid_id, bid_amount, end_time, end_time, 'expired' FROM ended WHERE user_id IS NOT NULL
"""


def _floor(m: Marketplace) -> DataFrame:
    arrivals = m["v_arrivals"]
    deliveries = [arrivals.where(F.col("delivery") == k).drop("delivery") for k in range(3)]
    known = pinned(m["v_snipe"])  # every delivery starts the job anew
    return replay_deliveries(deliveries, lambda bids: live.auction_events(bids, known, keep_hours=24 * 60), "floor")


@query("stream_auction_floor", _FLOOR)
def stream_auction_floor(m: Marketplace) -> DataFrame:
    return _floor(m)


@query("stream_fanout", f"""
    SELECT event_name, auction_id, user_id, bid_id, bid_amount, end_time, event_at,
           CASE WHEN event_name IN ('user-outbid', 'user-won') THEN 'user_' || CAST(user_id AS VARCHAR) ELSE 'everyone' END AS target
    FROM ({_FLOOR}) f WHERE event_name <> 'bid-rejected'
""")
def stream_fanout(m: Marketplace) -> DataFrame:
    return live.fanned_out(_floor(m)).drop("reason")


@query("stream_mail_throttle", _cooldown_sql("v_new_messages", 120))
def stream_mail_throttle(m: Marketplace) -> DataFrame:
    return replay(mail.throttle_mail(m.stream("events")["v_new_messages"]), "mail")


@query("stream_inbox", """
    SELECT conversation_id, max(sent_at) AS last_message_at, count(*) AS message_count,
           count(CASE WHEN is_read = FALSE AND is_from_admin = FALSE THEN 1 END) AS unread_count
    FROM v_messages GROUP BY conversation_id
""")
def stream_inbox(m: Marketplace) -> DataFrame:
    live = inbox.live_inbox(m.stream("conversations")["v_messages"])
    return replay_updates(live, ["conversation_id"], "inbox")


@query("stream_inbox_reads", """
    SELECT conversation_id, max(sent_at) AS last_message_at, count(*) AS message_count,
           count(CASE WHEN is_read = FALSE AND is_from_admin = FALSE AND id % 5 <> 0 THEN 1 END) AS unread_count
    FROM v_messages GROUP BY conversation_id
""")
def stream_inbox_reads(m: Marketplace) -> DataFrame:
    live = m.stream("conversations")["v_messages"]
    flips = live.where("is_read = false AND is_from_admin = false AND id % 5 = 0").select("id", "conversation_id")
    return replay_updates(inbox.live_inbox(live, flips), ["conversation_id"], "reads")


@query("stream_inbox_participants", """
    WITH totals AS (
        SELECT conversation_id, max(sent_at) AS last_message_at, count(*) AS message_count,
               count(CASE WHEN NOT is_read AND NOT is_from_admin AND id % 5 <> 0 THEN 1 END) AS unread_count
        FROM v_messages GROUP BY conversation_id)
    SELECT DISTINCT t.*, m.user_id, u.email, p.first_name, p.last_name
    FROM totals t JOIN v_messages m ON m.conversation_id = t.conversation_id
    JOIN v_users u ON u.id = m.user_id LEFT JOIN v_profiles p ON p.user_id = m.user_id
""")
def stream_inbox_participants(m: Marketplace) -> DataFrame:
    talk = m.stream("conversations")["v_messages"]
    flips = talk.where("is_read = false AND is_from_admin = false AND id % 5 = 0").select("id", "conversation_id")
    live_rows = seats.named_seats(seats.live_seats(talk, flips), m["v_users"], m["v_profiles"])
    return replay_updates(live_rows, ["conversation_id", "user_id"], "seats")


@query("bid_intake", """
    SELECT r.id, b.auction_id, CASE WHEN r.id % 19 = 0 THEN 0 ELSE b.user_id END AS user_id, CASE WHEN r.id % 19 = 0 THEN NULL ELSE b.bid_amount END AS bid_amount,
           CAST(NULL AS VARCHAR) AS record,
           concat_ws('; ', CASE WHEN coalesce(auction_id, 0) = 0 THEN 'auction_id is required' END,
                     CASE WHEN r.id % 19 = 0 OR coalesce(user_id, 0) = 0 THEN 'user_id is required' END,
                     CASE WHEN r.id % 19 = 0 OR coalesce(bid_amount, 0) = 0 THEN 'bid_amount is required' END) AS failed
    FROM v_bid_records r JOIN v_bids b ON b.id = r.id WHERE r.id % 17 <> 0 AND r.id % 23 <> 0
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, line, 'malformed record' FROM v_bid_records WHERE id % 17 = 0 OR id % 23 = 0
""")
def bid_intake(m: Marketplace) -> DataFrame:
    # the records of two deliveries, each of several files; a micro-batch takes what fits its bytes
    path = scratch_path(m.spark, "records")
    for k in (0, 1):
        m["v_bid_records"].where(F.col("id") % 2 == k).select("line").repartition(3).write.mode("append").text(path)
    judged = intake.judged(intake.read_records(m.spark, path, "bids", 100_000), quality.bid_rules())
    rows = replay(judged.drop("created_at", "updated_at"), "intake")
    return rows.select("id", "auction_id", "user_id", "bid_amount", "record", F.array_join("failed", "; ").alias("failed"))


@query("rate_limit_audit", """
    SELECT coalesce(email, 'no-email') AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits,
           count(*) - 1 AS excess
    FROM (SELECT ts, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email FROM v_live_events) e
    GROUP BY 1, 2 HAVING count(*) > 1
""")
def rate_limit_audit(m: Marketplace) -> DataFrame:
    events = m.stream("events")["v_live_events"]
    # NULL for the user without an id
    email = F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Example.com"))
    hits = windows.hits_per_window(events, windows.email_key(email), "1 hour")
    return windows.over_limit(replay_updates(hits, ["key", "window_start"], "rate"), 1)


@query("typing_sessions", """
    WITH marked AS (
        SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR lag(is_stop) OVER u
                            OR ts > lag(ts) OVER u + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS begins
        FROM v_typing WINDOW u AS (PARTITION BY conversation_id, user_id ORDER BY ts, id)),
    bursts AS (
        SELECT *, sum(begins) OVER (PARTITION BY conversation_id, user_id ORDER BY ts, id) AS burst FROM marked)
    SELECT conversation_id, user_id, min(ts) AS started_at, max(ts) AS last_event_at, count(*) AS n_events,
           CASE WHEN bool_or(is_stop) THEN 'stop' ELSE 'idle' END AS ended_by
    FROM bursts GROUP BY conversation_id, user_id, burst
    HAVING bool_or(is_stop)
        OR burst < (SELECT max(b.burst) FROM bursts b
                    WHERE b.user_id = bursts.user_id AND b.conversation_id = bursts.conversation_id)
        OR max(ts) + INTERVAL 30 MINUTE < (SELECT max(ts) FROM v_typing) - INTERVAL 10 MINUTE
""")
def typing_sessions(m: Marketplace) -> DataFrame:
    return replay(windows.typing_sessions(m.stream("events")["v_typing"], gap_seconds=1800), "typing")


@query("latest_status", """
    SELECT key, status, changed_at, id
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY changed_at DESC, id DESC) AS rn FROM v_status_changes) x
    WHERE rn = 1
""")
def latest_status(m: Marketplace) -> DataFrame:
    return inbox.replay_status(m.stream("events")["v_status_changes"])


# the opening of every second conversation is history, the rest arrives in the stream
_ROUTED_HISTORY = "conversation_id % 2 = 0 AND id % 100 = 0"


@query("message_routing", f"""
    WITH openers AS (
        SELECT conversation_id, min_by(user_id, (sent_at, id)) AS opener, min((sent_at, id)) AS opened
        FROM v_messages WHERE NOT is_from_admin GROUP BY conversation_id)
    SELECT v.id, v.conversation_id, v.user_id, v.is_from_admin,
           CASE WHEN NOT v.is_from_admin THEN {ADMIN_ID} WHEN o.opened < (v.sent_at, v.id) THEN o.opener
                ELSE v.user_id END AS recipient_id
    FROM v_messages v LEFT JOIN openers o ON o.conversation_id = v.conversation_id
    WHERE NOT ({_ROUTED_HISTORY.replace("conversation_id", "v.conversation_id")})
""")
def message_routing(m: Marketplace) -> DataFrame:
    live = m.stream("conversations")["v_messages"].where(f"NOT ({_ROUTED_HISTORY})")
    history = m["v_messages"].where(_ROUTED_HISTORY)
    return replay(routing.route_live(live, history, ADMIN_ID), "routing")


def _limit_sql(kind: str, key: str) -> str:
    limit, window = windows.LIMITS[kind]
    return f"""
        SELECT {key} AS key, time_bucket(INTERVAL '{window}', ts) AS window_start, count(*) AS hits,
               count(*) - {limit} AS excess
        FROM v_requests GROUP BY 1, 2 HAVING count(*) > {limit}
    """


def _audited(m: Marketplace, kind: str, key: Column) -> DataFrame:
    hits = windows.limit_audit(m.stream("events")["v_requests"], key, kind)
    return windows.over_limit(replay_updates(hits, ["key", "window_start"], "rate"), windows.LIMITS[kind][0])


@query("rate_limit_requests", _limit_sql("requests", "'site'"))
def rate_limit_requests(m: Marketplace) -> DataFrame:
    return _audited(m, "requests", F.lit("site"))


@query("rate_limit_test_requests", _limit_sql("requests in test", "'site'"))
def rate_limit_test_requests(m: Marketplace) -> DataFrame:
    return _audited(m, "requests in test", F.lit("site"))


@query("rate_limit_mail_actions", _limit_sql(
    "mail actions", "coalesce('user' || CAST(user_id AS VARCHAR) || '@example.com', 'no-email')"
))
def rate_limit_mail_actions(m: Marketplace) -> DataFrame:
    email = F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Example.com"))
    return _audited(m, "mail actions", windows.email_key(email))


@query("stream_bids_and_purchases", """
    WITH marked AS (
        SELECT *, max(bid_amount) OVER w AS mark, arg_max(user_id, bid_amount) OVER w AS holder
        FROM v_bids_and_purchases
        WINDOW w AS (PARTITION BY auction_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT id, auction_id, user_id, bid_amount, created_at, is_buy_now,
           CASE WHEN holder <> user_id THEN holder END AS outbid_user_id
    FROM marked WHERE mark IS NULL OR bid_amount > mark OR is_buy_now
""")
def stream_bids_and_purchases(m: Marketplace) -> DataFrame:
    return replay(live_bids.accept_bids(m.stream("events")["v_bids_and_purchases"]), "purchases")


# ---- input rules, permissions and edits -------------------------------------------------


def _checked(rows: DataFrame, rules: dict[str, Column], *columns: str) -> DataFrame:
    return quality.check(rows, rules).select(*columns, F.array_join("failed", "; ").alias("failed"))


def _failed(condition: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN '{message}' ELSE '' END AS failed"


@query("message_input_check", f"""
    SELECT id, {_failed("coalesce(message_content, '') = ''", "message_content is required")}
    FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 7 <> 1 THEN message_content END AS message_content FROM v_messages) x
""")
def message_input_check(m: Marketplace) -> DataFrame:
    text_ = F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 != 1, F.col("message_content"))
    return _checked(m["v_messages"].withColumn("message_content", text_), quality.message_rules(), "id")


@query("tracking_input_check", f"""
    SELECT id, {_failed("id % 3 <> 2", "tracking_number must be text")} FROM v_sales
""")
def tracking_input_check(m: Marketplace) -> DataFrame:
    number = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 2, F.concat(F.lit("T"), F.col("id")))
    return _checked(m["v_sales"].withColumn("tracking_number", number), quality.tracking_rules(), "id")


@query("paid_input_check", f"""
    SELECT id, {_failed("id % 4 > 1", "is_paid must be boolean")} FROM v_sales
""")
def paid_input_check(m: Marketplace) -> DataFrame:
    kind = F.col("id") % 4
    given = F.when(kind == 0, "true").when(kind == 1, "false").when(kind == 2, "yes")
    return _checked(m["v_sales"].withColumn("is_paid", given), quality.paid_rules(), "id")


@query("id_input_check", f"""
    SELECT id, {_failed("user_id % 4 = 0", "id must be digits")}
    FROM (SELECT id AS user_id, CASE WHEN id % 4 = 0 THEN 'u' ELSE '' END || CAST(id AS VARCHAR) AS id FROM v_users) x
""")
def id_input_check(m: Marketplace) -> DataFrame:
    given = F.concat(F.when(F.col("id") % 4 == 0, "u").otherwise(""), F.col("id").cast("string"))
    return _checked(m["v_users"].select(given.alias("id")), quality.id_rules(), "id")


@query("broadcast_input_check", """
    SELECT id, concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'subject is required' END,
                               CASE WHEN id % 3 = 0 THEN 'message is required' END) AS failed
    FROM v_posts
""")
def broadcast_input_check(m: Marketplace) -> DataFrame:
    rows = m["v_posts"].select(
        "id", F.when(F.col("id") % 5 == 0, " \t").otherwise("x").alias("subject"), F.when(F.col("id") % 3 != 0, "y").alias("message")
    )
    return _checked(rows, quality.broadcast_rules(), "id")


@query("managers", f"SELECT id, email, email IN ('{ADMIN_EMAIL}') AS is_admin FROM v_users")
def managers(m: Marketplace) -> DataFrame:
    return listings.may_manage(m["v_users"].select("id", "email"), [ADMIN_EMAIL])


@query("dropped_list_images", """
    SELECT o.post_id, o.image_url FROM v_image_edits o
    WHERE NOT EXISTS (FROM v_image_edits n WHERE n.kept AND n.post_id = o.post_id AND n.image_url = o.image_url)
""")
def dropped_list_images(m: Marketplace) -> DataFrame:
    lists = m["v_image_edits"].groupBy("post_id").agg(
        F.collect_list("image_url").alias("old"), F.collect_list(F.when(F.col("kept"), F.col("image_url"))).alias("new")
    )
    return lists.select("post_id", F.explode(listings.dropped_from_lists(F.col("old"), F.col("new"))).alias("image_url"))


@query("replaced_profile_images", """
    SELECT p.user_id, 'http://host.example/' || CAST(p.user_id AS VARCHAR) || '.jpg' AS image_url,
           CAST(p.user_id AS VARCHAR) || '.jpg' AS storage_key
    FROM v_profiles p WHERE p.user_id % 3 = 0 AND p.user_id % 2 = 0
""")
def replaced_profile_images(m: Marketplace) -> DataFrame:
    url = F.concat(F.lit("http://host.example/"), F.col("user_id").cast("string"), F.lit(".jpg"))
    profiles = m["v_profiles"].select("user_id", F.when(F.col("user_id") % 2 == 0, url).alias("image_url"))
    edits = m["v_profiles"].where("user_id % 3 = 0").select("user_id", F.lit("http://host.example/new.jpg").alias("image_url"))
    return users.replaced_images(profiles, edits)


@query("outbox_auction_tracking", f"""
    SELECT 'auction' AS kind, r.id AS auction_id, u.email AS to_address, 'Your package has shipped!' AS subject,
           'RB' || CAST(r.id AS VARCHAR) AS tracking_number, '{text.TRACKING_URL}RB' || CAST(r.id AS VARCHAR) AS tracking_url,
           '{notify.SITE}' AS home_url
    FROM v_results r JOIN v_users u ON u.id = r.winner_id WHERE r.is_paid
""")
def outbox_auction_tracking(m: Marketplace) -> DataFrame:
    number = F.when(F.col("is_paid"), F.concat(F.lit("RB"), F.col("id").cast("string")))
    return notify.tracking_outbox(
        m["v_results"].withColumn("tracking_number", number), m["v_users"], kind="auction", receiver="winner_id"
    )


# ---- typed scans: each table as it is stored, read back with its declared schema ---------

_STORED = {
    "users": "v_users", "listings": "v_posts", "listing_images": "v_imgs", "messages": "v_messages", "auctions": "v_auctions",
    "bids": "v_bids", "auction_results": "v_results", "sales": "v_sales", "notifications": "v_notifications", "error_log": "v_errors",
}
_SCANNED = {
    "users": "id, email", "listings": "id, title, price, author_id, hide", "listing_images": "id, post_id, image_url",
    "messages": "id, conversation_id, user_id, message_content, sent_at, is_read, is_from_admin",
    "auctions": "id, title, end_time, is_active", "bids": "id, auction_id, user_id, bid_amount, created_at",
    "auction_results": "id, auction_id, winner_id, final_bid, closed_at, closed_reason, is_paid",
    "sales": "id, post_id, buyer_id, is_paid, created_at", "notifications": "id, user_id, type, created_at, is_read",
    "error_log": "id, created_at",
}


def _scan(table: str) -> Query:
    def build(m: Marketplace) -> DataFrame:
        shape = empty_table(m.spark, table)
        rows = m[_STORED[table]]
        known = [f for f in shape.schema if f.name in rows.columns]
        path = scratch_path(m.spark, f"scan-{table}")
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in known)).write.parquet(path)
        return read_table(m.spark, path, table).selectExpr(*_SCANNED[table].split(", "))

    return build


for _table, _view in _STORED.items():
    query(f"scan_{_table}", f"SELECT {_SCANNED[_table]} FROM {_view}")(_scan(_table))


def _first_hit_sql(hits: str, window: str, limit: int) -> str:
    return f"""
        WITH RECURSIVE hits AS ({hits}),
        starts AS (
            SELECT key, min(ts) AS window_start FROM hits GROUP BY key
            UNION ALL
            SELECT s.key, min(h.ts) FROM starts s JOIN hits h ON h.key = s.key AND h.ts >= s.window_start + INTERVAL {window}
            GROUP BY s.key)
        SELECT h.key, s.window_start, count(*) AS hits, count(*) - {limit} AS excess
        FROM hits h ASOF JOIN starts s ON s.key = h.key AND s.window_start <= h.ts
        GROUP BY 1, 2 HAVING count(*) > {limit}
    """


_MAIL_HITS = "SELECT coalesce('user' || CAST(user_id AS VARCHAR) || '@example.com', 'no-email') AS key, ts FROM v_live_events WHERE ts IS NOT NULL"


def _mail_key() -> Column:
    return windows.email_key(F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@Example.com")))


@query("rate_limit_first_hit", _first_hit_sql(_MAIL_HITS, "7 DAY", 3))
def rate_limit_first_hit(m: Marketplace) -> DataFrame:
    return windows.over_limit(windows.hits_since_first(m["v_live_events"], _mail_key(), 7 * 86400), 3)


@query("stream_rate_limit_first_hit", _first_hit_sql(_MAIL_HITS, "7 DAY", 3))
def stream_rate_limit_first_hit(m: Marketplace) -> DataFrame:
    # three deliveries, one after the other in time
    whole = m["v_live_events"].where(F.col("ts").isNotNull())
    low, high = whole.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select("low", "high").first()
    third = F.floor(3 * (F.unix_micros(F.col("ts").cast("timestamp_ltz")) - F.unix_micros(F.lit(low).cast("timestamp_ltz")))
                    / (F.unix_micros(F.lit(high).cast("timestamp_ltz")) - F.unix_micros(F.lit(low).cast("timestamp_ltz")) + 1))
    deliveries = [whole.where(third == k) for k in range(3)]
    touched = replay_deliveries(deliveries, lambda hits: windows.live_hits_since_first(hits, _mail_key(), 7 * 86400), "first-hit")
    return windows.over_limit(touched.groupBy("key", "window_start").agg(F.max("hits").alias("hits")), 3)


@query("rate_limit_first_hit_requests", _first_hit_sql("SELECT 'site' AS key, ts FROM v_requests", "1 MINUTE", 150))
def rate_limit_first_hit_requests(m: Marketplace) -> DataFrame:
    return windows.over_limit(windows.hits_since_first(m["v_requests"], F.lit("site"), 60), 150)
