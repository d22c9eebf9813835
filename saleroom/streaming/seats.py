"""Live inbox per participant: every conversation as each of its participants sees it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.time import epoch_micros, ntz

PIECE = "conversation_id BIGINT, user_id BIGINT, last_us BIGINT, messages BIGINT, unread BIGINT"
ROW = "conversation_id BIGINT, user_id BIGINT, last_us BIGINT, message_count BIGINT, unread_count BIGINT"
_NOBODY = -(1 << 63)


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation and sender of an Arrow batch: a busy conversation sends few rows on."""
    for rows in batches:
        yield rows.groupby(["conversation_id", "user_id"], as_index=False).agg({"last_us": "max", "messages": "sum", "unread": "sum"})


class Seats(StatefulProcessor):
    """Per conversation: its totals, and a map of who takes part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "last_us BIGINT, messages BIGINT, unread BIGINT")
        self.seats = handle.getMapState("seats", "user_id BIGINT", "messages BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, messages, unread = self.totals.get() if self.totals.exists() else (_NOBODY, 0, 0)
        for part in rows:
            last = max(last, int(part["last_us"].max()))
            messages, unread = messages + int(part["messages"].sum()), unread + int(part["unread"].sum())
            for user, n in zip(part["user_id"].tolist(), part["messages"].tolist()):
                if n and user != _NOBODY:
                    before = self.seats.getValue((user,))[0] if self.seats.containsKey((user,)) else 0
                    self.seats.updateValue((user,), (before + n,))
        self.totals.update((last, messages, unread))
        users = sorted(k[0] for k in self.seats.keys())
        if users:
            yield pd.DataFrame({"conversation_id": key[0], "user_id": users, "last_us": last, "message_count": messages, "unread_count": unread})

    def close(self) -> None:
        pass


def live_seats(messages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """conversation_id, user_id, last_message_at, message_count, unread_count of every participant (update mode).

    `reads` is a stream of messages that were unread and have been read since (id,
    conversation_id), each once. A change of a conversation gives a row for each of its
    participants. Messages without a sender count, but seat nobody.
    """
    unread = F.coalesce((F.col("is_read") == F.lit(False)) & (F.col("is_from_admin") == F.lit(False)), F.lit(False))
    nobody = F.lit(_NOBODY).cast("bigint")
    pieces = messages.select(
        "conversation_id", F.coalesce("user_id", nobody).alias("user_id"), F.coalesce(epoch_micros(F.col("sent_at")), nobody).alias("last_us"),
        F.lit(1).cast("bigint").alias("messages"), unread.cast("bigint").alias("unread"),
    )
    if reads is not None:
        read = reads.select("conversation_id", nobody.alias("user_id"), nobody.alias("last_us"), F.lit(0).cast("bigint").alias("messages"), F.lit(-1).cast("bigint").alias("unread"))
        pieces = pieces.unionByName(read)
    seated = pieces.where(F.col("conversation_id").isNotNull()).mapInPandas(combined, PIECE)
    out = seated.groupBy("conversation_id").transformWithStateInPandas(Seats(), ROW, "Update", "None")
    moment = F.when(F.col("last_us") != nobody, F.timestamp_add("MICROSECOND", F.col("last_us"), ntz("1970-01-01")))
    return out.select("conversation_id", "user_id", moment.alias("last_message_at"), "message_count", "unread_count")


def named_seats(seats: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """The seats of known users with their address and name: a join with the stored tables."""
    who = users.select(F.col("id").alias("user_id"), "email")
    faces = profiles.select("user_id", "first_name", "last_name")
    return seats.join(who, "user_id").join(faces, "user_id", "left")
