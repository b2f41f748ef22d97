"""Keyed sessions with a fixed time to live over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session_key string, event_id bigint, ts timestamp, active boolean, opened_at timestamp"


class SessionProcessor(StatefulProcessor):
    """Holds one value per key, the last opening, and says of each event whether it falls inside.

    A session lasts from its opening for ``minutes`` (the exact end included); reads don't extend it and a
    later opening replaces it. Events are taken in time order within a micro-batch; an event older than the
    opening in state is outside. State is one timestamp per key; event-time timers drop it once the watermark
    has passed its end, so keys that fall silent cost nothing.
    """

    def __init__(self, minutes: int = 30):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        life = pd.Timedelta(minutes=self.minutes)
        at = pd.Timestamp(self.opened.get()[0]) if self.opened.exists() else None
        before = at
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event_id, ts, opens in zip(frame["event_id"], frame["ts"], frame["opens"], strict=True):
            if opens and (at is None or ts >= at):
                at = ts
            active = at is not None and at <= ts <= at + life
            out.append((str(key[0]), int(event_id), ts, active, at if active else pd.NaT))
        if at is not None and at != before:
            self.opened.update((at.to_pydatetime(),))
            self.handle.registerTimer(int((at + life).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["session_key", "event_id", "ts", "active", "opened_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.opened.exists():
            end = pd.Timestamp(self.opened.get()[0]) + pd.Timedelta(minutes=self.minutes)
            if end.timestamp() * 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.opened.clear()
        yield pd.DataFrame({"session_key": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[ns]"), "active": pd.Series(dtype=bool), "opened_at": pd.Series(dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, key: str, opens: str, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Session rows of a streaming ``events(event_id, ts, ..)``; ``opens`` is a SQL condition.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.select(F.col(key).cast("string").alias("session_key"), F.col("event_id").cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(opens).alias("opens"))
    return rows.withWatermark("ts", late).groupBy("session_key").transformWithStateInPandas(SessionProcessor(minutes), OUT, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events and their values per tumbling window and type, with a watermark for late rows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
