"""What the keyed stream operators share: event time, timers that close a sequence, its end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A sequence without rows for this long is closed unless an operator is told otherwise.
IDLE_MS = 24 * 3_600_000
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AT = "_at"


def _keep_state_on_disk(spark: SparkSession) -> None:
    """Named states and timers need the disk-based state store; a provider of the user's choice stays."""
    if "RocksDB" not in (spark.conf.get(PROVIDER_CONF, None) or ""):
        spark.conf.set(PROVIDER_CONF, PROVIDER)


def in_event_time(rows: DataFrame, time: str, delay: str, wanted: Column, columns: Sequence[str]) -> DataFrame:
    """The wanted rows, under a watermark on ``time`` (microseconds) that all rows advance.

    The condition depends on the event time, so it is not pushed below the watermark: rows that
    are not wanted, a marker for the end of a recording for instance, still move it on. The event
    time itself is left out, because Spark would drop late rows by it without saying which.
    """
    timed = rows.withColumn(_AT, F.timestamp_micros(F.col(time))).withWatermark(_AT, delay)
    return timed.where(F.when(F.col(_AT).isNotNull(), wanted).otherwise(F.lit(False))).select(*columns)


class Closing(StatefulProcessor):
    """A keyed operator whose state ends: ``idle_ms`` of event time after a sequence's newest row.

    Subclasses open their states in ``open``, say in ``closing_rows`` what is still to come out, and
    name their states in ``states``. Times are in microseconds.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def states(self) -> list:
        raise NotImplementedError

    def newest(self) -> int | None:
        """Time of the sequence's newest row from its state, if it has one."""
        raise NotImplementedError

    def closing_rows(self, key: tuple) -> Iterator[pd.DataFrame]:
        return iter(())

    def begin(self, newest: int) -> None:
        """The timer of a sequence that had no state. It is not moved with every batch: when it
        goes off, a sequence that has gone on meanwhile gets another one."""
        self.handle.registerTimer(newest // 1000 + self.idle_ms)

    def close_if_idle(self, key: tuple, watermark_ms: int) -> list[pd.DataFrame]:
        """Rows of the end of a sequence that the watermark has left behind; also where new rows of it
        come in before its timer goes off, so that it does not matter which batch they come in."""
        newest = self.newest()
        if newest is None or newest // 1000 + self.idle_ms > watermark_ms:
            return []
        rows = list(self.closing_rows(key))
        for state in self.states():
            state.clear()
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self.close_if_idle(key, timerValues.getCurrentWatermarkInMs())
        newest = self.newest()
        if newest is not None:
            self.handle.registerTimer(newest // 1000 + self.idle_ms)
        return iter(rows)

    def close(self) -> None:
        pass


def run_keyed(rows: DataFrame, seq: str, processor: Closing, out: T.StructType) -> DataFrame:
    """The processor's rows in append mode; its timers run on event time."""
    _keep_state_on_disk(rows.sparkSession)
    return rows.groupBy(seq).transformWithStateInPandas(processor, out, "append", "EventTime")


def sorted_rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of a sequence in a batch in order, whatever way Spark delivered them."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")
