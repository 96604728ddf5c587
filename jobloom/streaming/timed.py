"""Expiry over state in RocksDB with event-time timers, started from a batch snapshot and readable beside the stream."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting of the state store, and the store that holds state outside the executors' heap.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class LastSeen(StatefulProcessor):
    """Each key's last sight and the timer that ends it ``span`` milliseconds later; a later sight moves both."""

    def __init__(self, key: str, span: int):
        self.key, self.span = key, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, timer long")

    def _note(self, last: int, timers) -> None:
        known = self.seen.get()
        if known is not None:
            last = max(last, known[0])
            self.handle.deleteTimer(known[1])
        timer = max(last + self.span, timers.getCurrentWatermarkInMs() + 1)
        self.seen.update((last, timer))
        self.handle.registerTimer(timer)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        if len(initialState):
            self._note(_millis(initialState["at"].max()), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [_millis(some["at"].max()) for some in rows if len(some)]
        if found:
            self._note(max(found), timerValues)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, _ = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({self.key: [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def unseen_keys(stream: DataFrame, key: str, ts: str, days: int, delay: str = "0 seconds", snapshot: DataFrame | None = None) -> DataFrame:
    """(key, last_seen) of each key that event time has left unseen for ``days``; a key seen again starts anew.

    ``snapshot`` (key, last_seen) is what is known before the stream's first batch. Start the stream within ``rocksdb``.
    """
    kind = stream.schema[key].dataType.simpleString()
    marked = stream.select(key, F.col(ts).alias("at")).withWatermark("at", delay)
    first = None if snapshot is None else snapshot.select(key, F.col("last_seen").alias("at")).groupBy(key)
    return marked.groupBy(key).transformWithStateInPandas(LastSeen(key, days * 86_400_000), f"{key} {kind}, last_seen timestamp", "Append", "EventTime", first)


def state(spark: SparkSession, folder: str) -> DataFrame:
    """(key, last_seen) of the keys that a stopped or running stream with this progress folder still waits for."""
    rows = spark.read.format("statestore").option("stateVarName", "seen").load(folder)
    return rows.select("key.*", F.timestamp_millis("value.last").alias("last_seen"))
