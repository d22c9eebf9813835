"""Live bid acceptance: current bid per auction, outbid holders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BID_COLUMNS = "id BIGINT, auction_id BIGINT, user_id BIGINT, bid_amount INT, created_at TIMESTAMP_NTZ, is_buy_now BOOLEAN"
ACCEPTED = BID_COLUMNS + ", outbid_user_id BIGINT"


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["created_at", "id"], kind="stable", ignore_index=True)


def local_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drop bids that an earlier bid of the same Arrow batch already beats or equals.

    Such a bid can neither be accepted nor change the highest bid. What is left of an
    auction are its rising bids, so even a very busy auction sends few rows on. A buy-now
    is always accepted and stays.
    """
    for rows in batches:
        rows = rows.sort_values(["auction_id", "created_at", "id"], kind="stable")
        before = rows.groupby("auction_id")["bid_amount"].cummax().groupby(rows["auction_id"]).shift()
        yield rows[before.isna() | (rows["bid_amount"] > before) | rows["is_buy_now"].astype(bool)]


class BidJudge(StatefulProcessor):
    """Per auction: the highest bid and who placed it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "amount INT, user_id BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bids = _in_order(rows)
        start = self.best.get() if self.best.exists() else None
        amounts = bids["bid_amount"].to_numpy(dtype=np.int64)
        floor = start[0] if start else np.iinfo(np.int64).min
        before = np.maximum.accumulate(np.concatenate([[floor], amounts]))[:-1]
        taken = bids[(amounts > before) | bids["is_buy_now"].to_numpy(dtype=bool)]
        if taken.empty:
            return
        # whoever holds the highest bid before each row: a lower buy-now does not take it over
        raises = amounts > before
        at = np.maximum.accumulate(np.where(raises, np.arange(len(bids)), -1))
        previous = np.concatenate([[-1], at[:-1]])
        users = bids["user_id"].astype("Int64").reset_index(drop=True)
        holders = users.reindex(previous).reset_index(drop=True)
        if start:
            holders[previous < 0] = start[1]
        holders.index = bids.index
        holders = holders.loc[taken.index]
        # being outbid by oneself is no notice
        losers = holders.mask((holders == taken["user_id"]).fillna(False))
        if at[-1] >= 0:
            self.best.update((int(amounts[at[-1]]), int(users[at[-1]])))
        yield taken.assign(outbid_user_id=losers)[
            ["id", "auction_id", "user_id", "bid_amount", "created_at", "is_buy_now", "outbid_user_id"]
        ]

    def close(self) -> None:
        pass


def accept_bids(bids: DataFrame) -> DataFrame:
    """Accepted bids of a bid stream, each with the user it outbids (NULL for none).

    Within a micro-batch bids are judged in (created_at, id) order; a bid that arrives
    in a later micro-batch is judged against the state at that time. Rows flagged
    `is_buy_now`, where that column exists, are always accepted.
    """
    flagged = "is_buy_now" in bids.columns
    flag = F.coalesce(F.col("is_buy_now"), F.lit(False)) if flagged else F.lit(False)
    judged = (
        bids.select("id", "auction_id", "user_id", "bid_amount", "created_at", flag.alias("is_buy_now"))
        .mapInPandas(local_records, BID_COLUMNS)
        .groupBy("auction_id")
        .transformWithStateInPandas(BidJudge(), ACCEPTED, "Append", "None")
    )
    return judged if flagged else judged.drop("is_buy_now")
