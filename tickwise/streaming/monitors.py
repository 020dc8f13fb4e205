"""Tumbling chunks and online score monitors over streams.

Scores of a sequence count in event order within a batch and in arrival order across batches.
Rows without a sequence, order or score are no scores, but move the watermark on. A sequence
without scores for ``idle_ms`` of event time is closed and leaves no state; a score after that
begins it anew. Orders are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.schema import WARM_UP_WINDOWS
from tickwise.streaming.state import IDLE_MS, Closing, in_event_time, run_keyed, sorted_rows


def stream_tumbling(
    samples: DataFrame, seq: str, event_time: str, length: str, delay: str, aggs: dict[str, Column]
) -> DataFrame:
    """Fixed-length chunks per sequence; a chunk comes out once the watermark has passed it."""
    windowed = samples.withWatermark(event_time, delay).groupBy(seq, F.window(event_time, length))
    return windowed.agg(*[e.alias(o) for o, e in aggs.items()]).select(
        seq, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *aggs
    )


class Monitor(Closing):
    """A running mean; state is ``total`` (count, sum, newest order)."""

    def __init__(self, columns: tuple[str, str, str], warm_up: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.seq, self.order, self.score = columns
        self.warm_up = warm_up

    def open(self, handle) -> None:
        self.total = handle.getValueState("total", "count long, total double, newest long")

    def states(self) -> list:
        return [self.total]

    def newest(self) -> int | None:
        known = self.total.get()
        return known[2] if known else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.close_if_idle(key, timerValues.getCurrentWatermarkInMs())
        rows = sorted_rows(rows, [self.order])
        scores = rows[self.score].to_numpy(float)
        last = int(rows[self.order].iloc[-1])
        known = self.total.get()
        count, total, newest = known or (0, 0.0, last)
        n = count + np.arange(1, len(scores) + 1)
        # Added one by one onto the carried total, so batch borders leave no trace.
        sums = np.cumsum(np.r_[total, scores])[1:]
        self.total.update((int(n[-1]), float(sums[-1]), max(newest, last)))
        if not known:
            self.begin(last)
        yield pd.DataFrame({self.seq: [key[0]] * len(n), "n": n} | self.values(scores, n, sums))[lambda d: d["n"] >= self.warm_up]

    def values(self, scores: np.ndarray, n: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
        return {"p": sums / n}


class Tail(Monitor):
    """Mean of the last scores, which the list state ``kept`` holds."""

    def __init__(self, columns: tuple[str, str, str], k: int, warm_up: int, idle_ms: int) -> None:
        super().__init__(columns, warm_up, idle_ms)
        self.k = k

    def open(self, handle) -> None:
        super().open(handle)
        self.kept = handle.getListState("kept", "score double")

    def states(self) -> list:
        return [self.total, self.kept]

    def values(self, scores: np.ndarray, n: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
        k = self.k
        kept = np.array([x for (x,) in self.kept.get()], float)
        both = np.r_[kept, scores]
        padded = np.r_[np.zeros(max(k - 1 - len(kept), 0)), both[max(len(kept) - k + 1, 0) :]]
        self.kept.put([(float(x),) for x in both[-k:]])
        return {"p": np.lib.stride_tricks.sliding_window_view(padded, k).sum(axis=1) / np.minimum(n, k)}


class Alerts(Monitor):
    """Level of the running mean; the value state ``last`` has the level reported last."""

    def __init__(self, columns: tuple[str, str, str], threshold: float, warm_up: int, idle_ms: int) -> None:
        super().__init__(columns, warm_up, idle_ms)
        self.threshold = threshold

    def open(self, handle) -> None:
        super().open(handle)
        self.last = handle.getValueState("last", "level string")

    def states(self) -> list:
        return [self.total, self.last]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for shown in super().handleInputRows(key, rows, timerValues):
            if not len(shown):
                continue
            p = shown["p"].to_numpy()
            level = np.where(p < self.threshold * 0.5, "safe", np.where(p < self.threshold, "warn", "alarm")).astype(object)
            reported = self.last.get()
            changed = level != np.r_[[reported[0] if reported else None], level[:-1]]
            if changed.any():
                self.last.update((str(level[-1]),))
                yield shown.assign(level=level)[changed]


def _monitored(scores: DataFrame, seq: str, order: str, score: str, delay: str, processor: Monitor, extra: tuple[T.StructField, ...] = ()) -> DataFrame:
    out = T.StructType([
        T.StructField(seq, scores.schema[seq].dataType), T.StructField("n", T.LongType()), T.StructField("p", T.DoubleType()), *extra])
    wanted = F.col(seq).isNotNull() & F.col(score).isNotNull()
    return run_keyed(in_event_time(scores, order, delay, wanted, [seq, order, score]), seq, processor, out)


def stream_prefix_monitor(
    scores: DataFrame, seq: str, order: str, score: str, warm_up: int = WARM_UP_WINDOWS, idle_ms: int = IDLE_MS, delay: str = "0 seconds",
) -> DataFrame:
    """Mean score so far of every sequence, from the warm-up on."""
    return _monitored(scores, seq, order, score, delay, Monitor((seq, order, score), warm_up, idle_ms))


def stream_tail_monitor(
    scores: DataFrame, seq: str, order: str, score: str, k: int, warm_up: int = WARM_UP_WINDOWS, idle_ms: int = IDLE_MS, delay: str = "0 seconds",
) -> DataFrame:
    """Mean of the last ``k`` scores of every sequence.

    A share of the whole sequence is not known online, hence the fixed ``k``.
    """
    return _monitored(scores, seq, order, score, delay, Tail((seq, order, score), k, warm_up, idle_ms))


def stream_alerts(
    scores: DataFrame, seq: str, order: str, score: str, threshold: float, warm_up: int = WARM_UP_WINDOWS, idle_ms: int = IDLE_MS,
    delay: str = "0 seconds",
) -> DataFrame:
    """Changes of the alert level of the running mean; the first level counts as a change.

    A level that lasts over several batches is reported once.
    """
    level = T.StructField("level", T.StringType())
    return _monitored(scores, seq, order, score, delay, Alerts((seq, order, score), threshold, warm_up, idle_ms), (level,))
