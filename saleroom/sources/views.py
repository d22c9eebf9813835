"""The marketplace tables, derived from the parquet tables by plain SQL.

The SQL text below runs unchanged in Spark and in DuckDB, so a query and its check
read the same domain rows. `Marketplace` resolves the names lazily: a query that
touches bids only ever plans a scan of the two tables bids come from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from saleroom.session import configure

AS_OF = "2024-01-16 00:00:00"
PURGE_AS_OF = "2024-02-10 00:00:00"

BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

VIEWS = {
    "v_users": """
        SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email,
               c_custkey % 7 <> 0 AS is_verified
        FROM customer
    """,
    "v_profiles": """
        SELECT c_custkey AS user_id, c_mktsegment AS first_name,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE n_name END AS last_name,
               c_acctbal >= 0 AS send_email_notifications,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-15 20:00:00' + CAST(c_custkey % 240 AS INT) * INTERVAL '1' MINUTE END AS last_auction_email_at,
               CASE WHEN c_custkey % 4 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-15 23:00:00' + CAST(c_custkey % 60 AS INT) * INTERVAL '1' MINUTE END AS last_message_email_at,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey AS INT) * INTERVAL '1' MINUTE AS created_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_custkey % 10 <> 9
    """,
    "v_addresses": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'street ' || CAST(o_orderkey AS VARCHAR(20)) END AS address_line1,
               o_orderpriority AS city, o_orderstatus AS state,
               CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 9 = 0 THEN NULL ELSE '97201' END AS postal_code,
               o_orderdate AS created_at
        FROM orders
    """,
    "v_posts": """
        SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS description,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'cover/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' END AS image_url,
               CASE WHEN p_partkey % 17 = 0 THEN 'ask' ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR(20)) END AS price,
               p_partkey % 10 AS author_id, p_size % 5 = 0 AS sold,
               CASE WHEN p_size = 7 THEN NULL ELSE p_size % 10 = 0 END AS hide,
               p_size % 7 = 0 AS is_deleted,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey AS INT) * INTERVAL '1' MINUTE AS created_at
        FROM part
    """,
    "v_imgs": """
        SELECT o_orderkey AS id, o_custkey AS post_id,
               'img/' || CAST(o_orderkey AS VARCHAR(20)) || '.jpg' AS image_url
        FROM orders
    """,
    "v_auctions": """
        SELECT p_partkey AS id, p_name AS title, p_brand AS description,
               split('http://host.example/a' || CAST(p_partkey AS VARCHAR(20)) || '.jpg,http://host.example/b' || CAST(p_partkey AS VARCHAR(20)) || '.jpg', ',') AS image_urls,
               p_size AS start_price,
               CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS buy_now_price,
               TIMESTAMP '2024-01-01 00:00:00' + CAST((p_partkey * 97) % 43200 AS INT) * INTERVAL '1' MINUTE AS end_time,
               p_partkey % 20 <> 0 AS is_active, p_partkey % 10 AS creator_id
        FROM part
    """,
    "v_bids": """
        SELECT event_id AS id, (event_id * event_id) % (SELECT max(c_custkey) + 1 FROM customer) AS auction_id,
               user_id, CAST(round(value * 100) AS INT) AS bid_amount, ts AS created_at
        FROM events
    """,
    # the order in which bids reach the site: three deliveries, every thirteenth bid twelve days late
    "v_arrivals": """
        SELECT id, auction_id, user_id, bid_amount, created_at,
               CASE WHEN arrived_at < TIMESTAMP '2024-01-11 00:00:00' THEN 0
                    WHEN arrived_at < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END AS delivery
        FROM (SELECT *, created_at + CASE WHEN id % 13 = 0 THEN 12 ELSE 0 END * INTERVAL '1' DAY AS arrived_at FROM v_bids) x
    """,
    "v_snipe": """
        SELECT auction_id AS id, created_at + INTERVAL '30' SECOND AS end_time, true AS is_active
        FROM (SELECT auction_id, created_at, row_number() OVER (PARTITION BY auction_id ORDER BY created_at, id) AS rn FROM v_bids) x
        WHERE rn = 3
    """,
    "v_results": """
        SELECT a.id AS id, a.id AS auction_id, t.user_id AS winner_id, t.bid_amount AS final_bid,
               a.end_time AS closed_at, 'expired' AS closed_reason, a.id % 40 = 0 AS is_paid
        FROM v_auctions a
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY auction_id ORDER BY bid_amount DESC, created_at ASC, id ASC) AS rn FROM v_bids) t
          ON t.auction_id = a.id AND t.rn = 1
        WHERE NOT a.is_active
    """,
    "v_messages": """
        SELECT conv_id * 100 + turn AS id, conv_id AS conversation_id,
               CASE WHEN role = 'assistant' THEN 1 ELSE conv_id % 150 END AS user_id,
               text AS message_content,
               TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 60 + turn AS INT) * INTERVAL '1' MINUTE AS sent_at,
               CASE WHEN turn = 6 THEN NULL ELSE turn % 3 = 0 END AS is_read,
               role <> 'user' AS is_from_admin
        FROM conversations
    """,
    "v_new_messages": """
        SELECT event_id AS id, user_id, ts AS sent_at FROM events WHERE event_type = 'signup'
    """,
    "v_sales": """
        SELECT o_orderkey AS id, o_orderkey % 200 AS post_id, o_custkey AS buyer_id,
               CAST(o_totalprice AS DECIMAL(10,2)) AS price, o_orderstatus = 'F' AS is_paid, o_orderdate AS created_at
        FROM orders
    """,
    "v_sale_input": """
        SELECT o_orderkey AS id, o_orderkey % 200 AS post_id,
               CASE WHEN o_orderkey % 50 = 0 THEN 'nobody@example.com'
                    ELSE 'customer#' || lpad(CAST(o_custkey AS VARCHAR(20)), 9, '0') || '@example.com' END AS buyer_email,
               CASE WHEN o_orderkey % 33 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(10,2)) END AS price
        FROM orders
    """,
    "v_notifications": """
        SELECT event_id AS id, user_id, (event_id * event_id) % (SELECT max(c_custkey) + 1 FROM customer) AS auction_id,
               CASE WHEN event_type = 'purchase' THEN 'won' ELSE 'outbid' END AS type,
               ts AS created_at, event_id % 3 = 0 AS is_read
        FROM events WHERE event_type IN ('purchase', 'click')
    """,
    "v_profile_changes": """
        SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'New' END AS first_name,
               'Name' AS last_name, true AS send_email_notifications
        FROM customer WHERE c_custkey % 3 = 0
    """,
    "v_errors": """
        SELECT event_id AS id, 'error ' || CAST(event_id AS VARCHAR(20)) AS error, props AS context, ts AS created_at
        FROM events WHERE event_type = 'error'
    """,
    # site events behind the live fan-out: each row names an event and the ids it carries
    "v_live_events": """
        SELECT event_id AS id, ts,
               CASE WHEN event_type = 'view' THEN 'bid-placed'
                    WHEN event_type = 'click' THEN 'user-outbid'
                    WHEN event_type = 'purchase' THEN 'sale-created'
                    WHEN event_type = 'signup' THEN 'new_customer_message'
                    ELSE 'new_message' END AS event_name,
               CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS user_id,
               event_id % 3 = 0 AS is_from_admin,
               event_id AS item_id, user_id % 100 AS conversation_id
        FROM events
    """,
    # the image lists of listings before and after an edit
    "v_image_edits": """
        SELECT post_id, 'http://host.example/' || image_url AS image_url, id % 3 <> 0 AS kept
        FROM v_imgs
    """,
    # a new address for every changed profile
    "v_address_changes": """
        SELECT user_id, 'new street ' || CAST(user_id AS VARCHAR(20)) AS address_line1,
               coalesce(first_name, 'Town') AS city, 'OR' AS state, '97202' AS postal_code
        FROM v_profile_changes
    """,
    # requested auction edits; a NULL field means "keep"
    "v_auction_changes": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Lot ' || p_name END AS title,
               CASE WHEN p_size > 25 THEN NULL ELSE p_size * 2 END AS start_price,
               CASE WHEN p_partkey % 5 = 0 THEN FALSE ELSE NULL END AS is_active
        FROM part WHERE p_type <> 'LARGE'
    """,
    # buy-now requests
    "v_buy_now": """
        SELECT event_id AS id, (event_id * event_id) % (SELECT max(c_custkey) + 1 FROM customer) AS auction_id,
               user_id, ts AS created_at
        FROM events WHERE event_type = 'purchase'
    """,
    # typing events; a purchase ends the burst
    "v_typing": """
        SELECT event_id AS id, event_id % 2 AS conversation_id, user_id, ts, event_type = 'purchase' AS is_stop FROM events
    """,
    # requests of a busy site: five a second
    "v_requests": """
        SELECT event_id AS id, user_id,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(floor(event_id / 5.0) AS INT) AS ts
        FROM events
    """,
    # what visitors looked for: parts of names and makers, some with wildcards, some very short
    "v_terms": """
        SELECT CASE WHEN p_partkey % 5 = 0 THEN substr(p_name, 1, 1) || '%' || substr(p_name, 4, 3)
                    WHEN p_partkey % 7 = 0 THEN substr(p_brand, 1, 3) || '_' || substr(p_brand, 5, 4)
                    WHEN p_partkey % 41 = 0 THEN upper(substr(p_name, 2, 2))
                    WHEN p_partkey % 211 = 0 THEN substr('%_', 1, CAST(p_partkey % 2 AS INT))
                    ELSE substr(p_name, 1 + CAST(p_partkey % 4 AS INT), 4 + CAST(p_size % 7 AS INT)) END AS term
        FROM part
    """,
    # bids as the site receives them: JSON texts, some cut short, some with a wrong type, some without an amount
    "v_bid_records": """
        SELECT id, CASE WHEN id % 17 = 0 THEN chr(123) || '"id":' || CAST(id AS VARCHAR(20)) || ',"auction_id":'
                        WHEN id % 23 = 0 THEN chr(123) || '"id":' || CAST(id AS VARCHAR(20)) || ',"bid_amount":"much"' || chr(125)
                        WHEN id % 19 = 0 THEN chr(123) || '"id":' || CAST(id AS VARCHAR(20)) || ',"auction_id":' || CAST(auction_id AS VARCHAR(20)) || ',"user_id":0' || chr(125)
                        ELSE chr(123) || '"id":' || CAST(id AS VARCHAR(20)) || ',"auction_id":' || CAST(auction_id AS VARCHAR(20))
                             || ',"user_id":' || CAST(user_id AS VARCHAR(20)) || ',"bid_amount":' || CAST(bid_amount AS VARCHAR(20)) || chr(125) END AS line
        FROM v_bids
    """,
    # all bids, buy-now purchases among them
    "v_bids_and_purchases": """
        SELECT id, auction_id, user_id, bid_amount, created_at, id % 11 = 0 AS is_buy_now FROM v_bids
    """,
    # status changes of a sale or message, keyed by user
    "v_status_changes": """
        SELECT event_id AS id, user_id AS key, event_type AS status, ts AS changed_at FROM events
    """,
}

_FROM = re.compile(r"\b(FROM|JOIN)\s+(\w+)")


def names_in(sql: str) -> list[str]:
    """Tables and views a statement reads directly, in order of appearance."""
    found = []
    for _, name in _FROM.findall(sql):
        if (name in VIEWS or name in BASE_SCHEMAS) and name not in found:
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """Put the views a statement needs in front of it, as CTEs (for DuckDB)."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {ctes}\nSELECT * FROM ({sql}) AS answer"


class Marketplace:
    """Lazy DataFrames over one data folder: `m["v_bids"]`, `m["orders"]`, `m.sql(...)`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in VIEWS:
                self._frames[name] = self.sql(VIEWS[name])
            else:
                self._frames[name] = self.spark.read.schema(BASE_SCHEMAS[name]).parquet(
                    f"{self.path}/{name}.parquet"
                )
        return self._frames[name]

    def sql(self, text: str) -> DataFrame:
        """Run a statement over the tables and views, without registering any name."""
        frames = {name: self[name] for name in names_in(text)}
        braced = _FROM.sub(
            lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], text
        )
        return self.spark.sql(braced, **frames)

    def stream(self, name: str) -> "Marketplace":
        """The same folder with one base table read as a stream, for live jobs."""
        live = Marketplace(self.spark, self.path)
        live._frames[name] = (
            self.spark.readStream.schema(BASE_SCHEMAS[name])
            # a one-file glob: the other tables share the folder
            .parquet(f"{self.path}/{name}.parque[t]")
        )
        return live
