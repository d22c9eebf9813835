"""Fan-out of site events to the rooms that receive them. Stateless: batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which rooms each event goes to.
TO_EVERYONE = ["auction-created", "auction-ended", "auction-extended", "bid-placed", "auction-BIN"]
TO_USER = ["user-outbid", "user-won", "tracking-info", "auction-paid"]
TO_USER_AND_ADMIN = ["sale-paid", "sale-tracking-info", "sale-created"]
TO_CONVERSATION = ["new_message", "conversation_updated", "message_read"]
TO_RECIPIENT = ["message_notify"]
TO_ADMIN_FROM_CUSTOMER = ["new_customer_message"]


def targets() -> Column:
    """The rooms of an event row, from event_name, user_id, conversation_id, is_from_admin.

    An event without the id its room needs reaches nobody.
    """
    name = F.col("event_name")
    user_room = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    talk_room = F.concat(F.lit("conversation_"), F.col("conversation_id").cast("string"))
    admin_room = F.lit("admin_room")
    has_user = F.coalesce(F.col("user_id") != 0, F.lit(False))
    from_customer = ~F.coalesce("is_from_admin", F.lit(False))
    rooms = (
        F.when(name.isin(TO_EVERYONE), F.array(F.lit("everyone")))
        .when(name.isin(TO_USER + TO_RECIPIENT), F.array(user_room))
        .when(name.isin(TO_USER_AND_ADMIN) & has_user, F.array(user_room, admin_room))
        .when(name.isin(TO_CONVERSATION), F.array(talk_room))
        .when(name.isin(TO_ADMIN_FROM_CUSTOMER) & from_customer, F.array(admin_room))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_compact(rooms)


def fan_out(events: DataFrame) -> DataFrame:
    """One row per event and room."""
    return events.withColumn("target", F.explode(targets()))
