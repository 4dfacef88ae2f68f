"""Keyed state over streams: newest issue per forecast, stale connections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STALE_AFTER_MS = 600_000


def newest_issue_stream(tasks: DataFrame) -> DataFrame:
    """Per batch and forecast that it touches: the newest issue so far, run in update mode.

    ``tasks`` has (forecast_id, issue_ts TIMESTAMP, seq).  A streaming maximum:
    batches are combined before the shuffle, state is one time and one number
    per forecast; results older than it are superseded.
    """
    newest = tasks.groupBy("forecast_id").agg(F.max(F.struct("issue_ts", "seq")).alias("_n"))
    return newest.select("forecast_id", F.col("_n.issue_ts").alias("issue_ts"), F.col("_n.seq").alias("seq"))


class Silence(StatefulProcessor):
    """When a connection last spoke, and a timer that goes off when it has been silent too long."""

    def __init__(self, name: str, stale_after_ms: int, event_time: bool):
        self.name, self.stale_after_ms, self.event_time = name, stale_after_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_us BIGINT, expires_ms BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        newest = max(row["last_us"] for row in rows)
        if self.last.exists():
            before, expires = self.last.get()
            newest = max(newest, before)
            self.handle.deleteTimer(expires)
        spoken_ms = newest // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.last.update((newest, spoken_ms + self.stale_after_ms))
        self.handle.registerTimer(spoken_ms + self.stale_after_ms)
        yield Row(**{self.name: key[0], "last_us": newest, "stale": False})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        last, _ = self.last.get()
        self.last.clear()
        yield Row(**{self.name: key[0], "last_us": last, "stale": True})


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_in_batch(messages: DataFrame, key: str) -> DataFrame:
    """Messages combined before they travel: of each Arrow batch, the newest time of every key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            newest = pa.Table.from_batches([batch]).group_by("key").aggregate([("ts", "max")]).rename_columns({"key": "key", "ts_max": "ts"})
            yield from newest.select(["key", "ts"]).to_batches()

    return messages.select(F.col(key).alias("key"), "ts").mapInArrow(run, "key STRING, ts TIMESTAMP")


def staleness_stream(messages: DataFrame, key: str, stale_after_ms: int = STALE_AFTER_MS, event_time: bool = False) -> DataFrame:
    """A row when a connection speaks (``stale`` false) and when it has been silent too long (true).

    ``messages`` has the text ``key`` column and ``ts`` (TIMESTAMP).  A key that
    never spoke has no state and is not stale; one that was stale and speaks again
    starts anew.  Time is that of the machine, or with ``event_time`` that of the
    messages, as far as the newest one has come.  State is one row and one timer a
    key, in RocksDB, which keyed timers need.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    newest = newest_in_batch(messages, key)
    if event_time:
        newest = newest.withWatermark("ts", "0 seconds")
    spoken = newest.select("key", F.unix_micros("ts").alias("last_us"), *(["ts"] if event_time else []))
    return spoken.groupBy("key").transformWithState(
        Silence(key, stale_after_ms, event_time), f"{key} STRING, last_us BIGINT, stale BOOLEAN", "Update", "EventTime" if event_time else "ProcessingTime"
    )
