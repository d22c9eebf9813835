"""Live mail throttling: at most one mail per user and cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saleroom.functions.time import epoch_micros
from saleroom.operators.notify import ITEM_COOLDOWN_MINUTES


class MailGate(StatefulProcessor):
    """Per user: the time of the last mail, until the cooldown after it is over."""

    def __init__(self, gap_us: int, exempt: int | None, inclusive: bool):
        self.gap = gap_us
        self.exempt = exempt
        # item mails need strictly more than the gap, message mails at least the gap
        self.side = "left" if inclusive else "right"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["at_us"].to_numpy(dtype=np.int64) for part in rows]))
        if self.exempt is not None and key[0] == self.exempt:
            sent = times.tolist()
        else:
            at = 0
            if self.last.exists():
                at = int(np.searchsorted(times, self.last.get()[0] + self.gap, side=self.side))
            sent = []
            while at < len(times):  # one turn per mail
                sent.append(int(times[at]))
                at = int(np.searchsorted(times, times[at] + self.gap, side=self.side))
        if sent:
            if self.last.exists():
                self.handle.deleteTimer(self._over(self.last.get()[0]))
            self.last.update((sent[-1],))
            self.handle.registerTimer(self._over(sent[-1]))
            yield pd.DataFrame({"user_id": key[0], "at_us": sent})

    def _over(self, last_us: int) -> int:
        """When the watermark has come so far, no arrival on time meets the cooldown any more."""
        return (last_us + self.gap) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self._over(self.last.get()[0]):
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def throttle_mail(
    arrivals: DataFrame,
    minutes: int = ITEM_COOLDOWN_MINUTES,
    exempt_user: int | None = None,
    inclusive: bool = False,
    delay: str = "10 minutes",
) -> DataFrame:
    """The arrivals (user_id, sent_at) that lead to a mail, as (user_id, sent_at).

    A user's state goes when the watermark (the newest arrival less `delay`) has passed the
    cooldown, so the state holds the users of the last cooldown only. No arrival is dropped;
    one later than `delay` is judged by what state is left.

    `exempt_user` (the admin) gets every mail. `inclusive` allows a mail exactly at
    the end of the cooldown.
    """
    timed = arrivals.withColumn("_event", F.col("sent_at").cast("timestamp_ltz")).withWatermark("_event", delay)
    # without the watermark's column in it, Spark takes no late rows out of the operator's input
    keyed = timed.select("user_id", epoch_micros(F.col("sent_at")).alias("at_us"))
    gate = MailGate(minutes * 60_000_000, exempt_user, inclusive)
    sent = keyed.groupBy("user_id").transformWithStateInPandas(
        gate, "user_id BIGINT, at_us BIGINT", "Append", "EventTime"
    )
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return sent.select("user_id", F.timestamp_add("MICROSECOND", F.col("at_us"), epoch).alias("sent_at"))
