"""Live message routing: who is notified of a message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.ids import pinned
from saleroom.functions.time import epoch_micros

ROUTED = "id BIGINT, conversation_id BIGINT, user_id BIGINT, is_from_admin BOOLEAN, recipient_id BIGINT"


class Router(StatefulProcessor):
    """Per conversation: its first customer message so far."""

    def __init__(self, admin_id: int):
        self.admin = admin_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at_us BIGINT, id BIGINT, user_id BIGINT")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.sort_values(["at_us", "id"]).iloc[0]
        self.first.update((int(row["at_us"]), int(row["id"]), int(row["user_id"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "id"], kind="stable")
        first = self.first.get() if self.first.exists() else None
        admin = batch["is_from_admin"].fillna(False).astype(bool)
        customers = batch[~admin & batch["user_id"].notna()]
        if len(customers):
            found = tuple(int(v) for v in customers[["at_us", "id", "user_id"]].iloc[0])
            if first is None or found[:2] < first[:2]:
                first = found
                self.first.update(first)
        target = pd.Series(self.admin, index=batch.index, dtype="Int64")
        target[admin] = batch["user_id"].astype("Int64")[admin]
        if first is not None:
            after = (batch["at_us"] > first[0]) | ((batch["at_us"] == first[0]) & (batch["id"] > first[1]))
            target[admin & after] = first[2]
        yield batch.assign(conversation_id=key[0], recipient_id=target)[
            ["id", "conversation_id", "user_id", "is_from_admin", "recipient_id"]
        ]

    def close(self) -> None:
        pass


def _narrow(messages: DataFrame) -> DataFrame:
    return messages.select("id", "conversation_id", "user_id", "is_from_admin", epoch_micros(F.col("sent_at")).alias("at_us"))


def route_live(messages: DataFrame, history: DataFrame, admin_id: int) -> DataFrame:
    """Who is notified of each message of a stream: the admin, or the customer an admin writes to.

    The customer of a conversation is the sender of its first customer message up to the
    message in question, from `history` (read once, when the stream first starts) or from the
    stream; before there is one, an admin's message falls back to its own user. State is one
    row per conversation.
    """
    customers = history.where(~F.coalesce("is_from_admin", F.lit(False)) & F.col("user_id").isNotNull())
    first = _narrow(customers).groupBy("conversation_id").agg(F.min(F.struct("at_us", "id", "user_id")).alias("_f"))
    start = pinned(first.select("conversation_id", "_f.at_us", "_f.id", "_f.user_id"))
    return _narrow(messages).groupBy("conversation_id").transformWithStateInPandas(
        Router(admin_id), ROUTED, "Append", "None", start.groupBy("conversation_id")
    )
