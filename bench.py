"""Headline query timings; prints one JSON line.

BENCH_SF_DIR: data folder (default sf0.1). BENCH_CPUS: local cores (default 8).
Each query is built and fully evaluated into a no-op sink; `value` is the sum of the
best of two runs after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from saleroom import queries as catalogue  # noqa: E402
from saleroom.session import local_session  # noqa: E402

HEADLINES = [
    "close_expired_auctions", "close_expired_messages", "accepted_bids", "outbid_notices", "top_bid",
    "extended_end_time", "mail_after_cooldown", "inbox_summary", "messages_with_email", "sales_report",
    "buyer_sales", "outstanding_by_buyer", "listing_cards", "search_listings", "user_directory",
    "latest_address", "upsert_addresses", "assign_conversations", "record_sales", "cascade_delete",
    "outbox_message", "decrypt_messages", "event_fanout",
]
STREAMS = ["stream_bids", "rate_limit_audit"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cores, "bench", os.environ.get("BENCH_MEMORY", "12g"))
    built = catalogue.spark_queries()

    def timed(name: str) -> float:
        start = time.perf_counter()
        built[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed("scan_profiles")
    seconds = {}
    for name in only or HEADLINES + STREAMS:
        runs = 1 if name in STREAMS else 2
        seconds[name] = round(min(timed(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline query seconds, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
