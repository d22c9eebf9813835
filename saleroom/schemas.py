"""Table schemas of the marketplace, their column defaults and child tables.

Timestamps are zone-less (UTC); bids are whole currency units, sale prices are
DECIMAL(10,2), listing prices are free text.
"""

from __future__ import annotations

# Schemas are DDL strings: they need no running session to be declared.
USERS = (
    "id BIGINT, email STRING, password_hash STRING, is_verified BOOLEAN, "
    "verification_token_version INT, password_reset_token_version INT"
)
LISTINGS = (
    "id BIGINT, created_at TIMESTAMP_NTZ, title STRING, description STRING, image_url STRING, "
    "category STRING, price STRING, author_id BIGINT, public_id STRING, num_imgs BIGINT, "
    "sold BOOLEAN, hide BOOLEAN, selling_link STRING, is_deleted BOOLEAN, "
    "deleted_at TIMESTAMP_NTZ, original_price STRING, discounted_price STRING"
)
LISTING_IMAGES = ("id BIGINT, post_id BIGINT, image_url STRING, public_id STRING")
PROFILES = (
    "id BIGINT, user_id BIGINT, first_name STRING, last_name STRING, image_url STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, show_welcome BOOLEAN, "
    "send_email_notifications BOOLEAN, last_auction_email_at TIMESTAMP_NTZ, "
    "last_message_email_at TIMESTAMP_NTZ, last_post_email_at TIMESTAMP_NTZ"
)
ADDRESSES = (
    "id BIGINT, user_id BIGINT, address_line1 STRING, address_line2 STRING, city STRING, "
    "state STRING, postal_code STRING, country_code STRING, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)
MESSAGES = (
    "id BIGINT, conversation_id BIGINT, user_id BIGINT, message_content STRING, "
    "sent_at TIMESTAMP_NTZ, is_read BOOLEAN, is_from_admin BOOLEAN"
)
AUCTIONS = (
    "id BIGINT, title STRING, description STRING, image_urls ARRAY<STRING>, start_price INT, "
    "buy_now_price INT, current_bid INT, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, "
    "is_active BOOLEAN, creator_id BIGINT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
BIDS = (
    "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)
RESULTS = (
    "id BIGINT, auction_id BIGINT, winner_id BIGINT, final_bid INT, closed_at TIMESTAMP_NTZ, "
    "closed_reason STRING, is_paid BOOLEAN, tracking_number STRING"
)
NOTIFICATIONS = (
    "id BIGINT, user_id BIGINT, auction_id BIGINT, type STRING, created_at TIMESTAMP_NTZ, "
    "is_read BOOLEAN"
)
SALES = (
    "id BIGINT, post_id BIGINT, buyer_id BIGINT, price DECIMAL(10,2), tracking_number STRING, "
    "is_paid BOOLEAN, paid_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
ERRORS = ("id BIGINT, created_at TIMESTAMP_NTZ, error STRING, context STRING")
SITE_MESSAGE = ("id BIGINT, message STRING, updated_at TIMESTAMP_NTZ")

TABLES = {
    "users": USERS,
    "listings": LISTINGS,
    "listing_images": LISTING_IMAGES,
    "profiles": PROFILES,
    "addresses": ADDRESSES,
    "messages": MESSAGES,
    "auctions": AUCTIONS,
    "bids": BIDS,
    "auction_results": RESULTS,
    "notifications": NOTIFICATIONS,
    "sales": SALES,
    "error_log": ERRORS,
    "site_message": SITE_MESSAGE,
}

# Column defaults, as Spark SQL; `:as_of` stands for the time of the insert.
DEFAULTS: dict[str, dict[str, str]] = {
    "users": {
        "is_verified": "false",
        "verification_token_version": "1",
        "password_reset_token_version": "1",
    },
    "listings": {"created_at": ":as_of", "sold": "false", "hide": "false", "is_deleted": "false"},
    "listing_images": {},
    "profiles": {
        "created_at": ":as_of",
        "updated_at": ":as_of",
        "show_welcome": "true",
        "send_email_notifications": "true",
    },
    "addresses": {"country_code": "'US'", "created_at": ":as_of", "updated_at": ":as_of"},
    "messages": {"sent_at": ":as_of", "is_read": "false", "is_from_admin": "false"},
    "auctions": {
        "image_urls": "array()",
        "start_time": ":as_of",
        "is_active": "true",
        "creator_id": "1",
        "created_at": ":as_of",
        "updated_at": ":as_of",
    },
    "bids": {"created_at": ":as_of", "updated_at": ":as_of"},
    "auction_results": {"closed_at": ":as_of", "is_paid": "false"},
    "notifications": {"created_at": ":as_of", "is_read": "false"},
    "sales": {"is_paid": "false", "created_at": ":as_of", "updated_at": ":as_of"},
    "error_log": {"created_at": ":as_of"},
    "site_message": {"updated_at": ":as_of"},
}

# Children removed with their parent: parent -> [(child table, child key)].
CASCADES: dict[str, list[tuple[str, str]]] = {
    "users": [
        ("profiles", "user_id"),
        ("addresses", "user_id"),
        ("messages", "user_id"),
        ("bids", "user_id"),
        ("auctions", "creator_id"),
        ("notifications", "user_id"),
    ],
    "listings": [("listing_images", "post_id")],
    "auctions": [("bids", "auction_id"), ("notifications", "auction_id")],
}
