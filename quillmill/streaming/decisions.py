"""Streams of suggestion decisions. An addition of this engine: the batch operators need none of it.

`counted` counts actions in tumbling windows of event time; `latest` keeps the last decision of each suggestion in state.
Both drop what comes later than the watermark allows and let state go: windows when the watermark has passed them, a
suggestion when it has passed its last decision by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = ("accept", "ignore")
#: What a stream's state store has to be for `latest`; set it on the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def counted(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, action, n of a stream of events (ts, action) in tumbling windows."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "action", "n")


class LastDecision(StatefulProcessor):
    """Of a suggestion's decisions the one of the highest seq, whatever order they come in, until its timer runs out."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, action string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        best, until = before and (before[0], before[1]), before[2] if before else 0
        for part in rows:
            for seq, action, ts in zip(part["seq"], part["action"], part["ts"], strict=True):
                # Of one seq the first action by name counts, so that the order of arrival never does.
                if best is None or seq > best[0] or seq == best[0] and action < best[1]:
                    best = (int(seq), action)
                until = max(until, int(ts.value // 1_000_000) + self.keep_ms)
        if before is None or best != (before[0], before[1]) or until != before[2]:
            if before is not None:
                self.handle.deleteTimer(before[2])
            self.handle.registerTimer(until)
            self.last.update((*best, until))
        if before is None or best != (before[0], before[1]):
            yield pd.DataFrame({"suggestion_id": [key[0]], "action": [best[1]], "seq": [best[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest(events: DataFrame, keep: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """suggestion_id, action, seq of a stream of events (suggestion_id, seq, action, ts), a row whenever a suggestion's
    last decision changes; output mode update. Actions that decide nothing, and events without seq or ts, are left out.

    A decision that comes after its suggestion's state has gone stands for itself.
    """
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    own = events.where(F.col("action").isin(*ACTIONS) & F.col("seq").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    grouped = own.select("suggestion_id", F.col("seq").cast("long").alias("seq"), "action", "ts").groupBy("suggestion_id")
    return grouped.transformWithStateInPandas(LastDecision(ms), "suggestion_id long, action string, seq long", "update", "eventTime")
