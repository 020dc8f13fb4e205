"""Hold resampling of a stream: the batch operator's grid with carried state per sequence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.streaming.state import IDLE_MS, Closing, in_event_time, run_keyed, sorted_rows

KIND, TICK, LATE = "kind", "tick", "late"
LATE_FIELDS = ("late_topic", "late_value", "behind")


class Hold(Closing):
    """State: grid start, next tick, newest sample, and time and value of each topic's last sample."""

    def __init__(self, columns: Sequence[str], names: Sequence[str], step: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.seq, self.time, self.topic, self.value = columns
        self.names, self.step = list(names), step

    def open(self, handle) -> None:
        # One state for all: every access is a call to the JVM.
        self.grid = handle.getValueState("grid", "t0 long, next_tick long, last_t long, at array<long>, held array<double>")

    def states(self) -> list:
        return [self.grid]

    def newest(self) -> int | None:
        known = self.grid.get()
        return known[2] if known else None

    def _frame(self, key: tuple, n: int, columns: dict) -> pd.DataFrame:
        blank = {self.seq: [key[0]] * n, "tick": None, self.time: None, **dict.fromkeys(self.names), KIND: None, **dict.fromkeys(LATE_FIELDS)}
        return pd.DataFrame(blank | columns)

    def _ticks(self, key: tuple, t0: int, ticks: np.ndarray, columns: list) -> pd.DataFrame:
        return self._frame(
            key, len(ticks), {"tick": ticks, self.time: t0 + ticks * self.step, **dict(zip(self.names, columns, strict=True)), KIND: TICK})

    def _late(self, key: tuple, rows: pd.DataFrame, settled: int) -> pd.DataFrame:
        t = rows[self.time].to_numpy(np.int64)
        return self._frame(key, len(rows), {
            self.time: t, "late_topic": rows[self.topic].to_numpy(), "late_value": rows[self.value].to_numpy(float), "behind": settled - t, KIND: LATE})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.close_if_idle(key, timerValues.getCurrentWatermarkInMs())
        rows = sorted_rows(rows, [self.time, self.topic, self.value])
        t = rows[self.time].to_numpy(np.int64)
        known = self.grid.get()
        if known:
            t0, next_tick, last_t, *held = known
            held = {name: sample for name, *sample in zip(self.names, *held, strict=True) if sample[0] is not None}
            settled = t0 + (next_tick - 1) * self.step
            on_time = t > settled
        else:
            settled = timerValues.getCurrentWatermarkInMs() * 1000
            on_time = t >= settled
            held = {}
        if not on_time.all():
            yield self._late(key, rows[~on_time], settled)
            rows, t = rows[on_time], t[on_time]
        if not len(t):
            return
        if not known:
            t0, next_tick, last_t = int(t[0]), 0, int(t[0])
        last_t = max(last_t, int(t[-1]))
        # Ticks strictly before the newest sample are settled; the one at it waits for other topics.
        ticks = np.arange(next_tick, max(next_tick, -(-(last_t - t0) // self.step)), dtype=np.int64)
        at = t0 + ticks * self.step
        which, values = rows[self.topic].to_numpy(), rows[self.value].to_numpy(float)
        columns = []
        for name in self.names:
            mine = which == name
            tj, vj = t[mine], values[mine]
            if name in held:
                tj, vj = np.r_[held[name][0], tj], np.r_[np.nan if held[name][1] is None else held[name][1], vj]
                order = np.argsort(tj, kind="stable")
                tj, vj = tj[order], vj[order]
            found = np.searchsorted(tj, at, side="right") - 1
            columns.append(np.where(found >= 0, vj[np.maximum(found, 0)], np.nan) if len(tj) else np.full(len(at), np.nan))
            if len(tj):
                held[name] = int(tj[-1]), None if np.isnan(vj[-1]) else float(vj[-1])
        samples = [held.get(n, (None, None)) for n in self.names]
        self.grid.update((t0, next_tick + len(ticks), last_t, [at for at, _ in samples], [value for _, value in samples]))
        if not known:
            self.begin(last_t)
        if len(ticks):
            yield self._ticks(key, t0, ticks, columns)

    def closing_rows(self, key) -> Iterator[pd.DataFrame]:
        t0, next_tick, last_t, _, held = self.grid.get()
        if t0 + next_tick * self.step == last_t:
            yield self._ticks(key, t0, np.array([next_tick]), [np.array([np.nan if x is None else x]) for x in held])


def stream_hold_tagged(
    samples: DataFrame, seq: str, time: str, topic: str, value: str, topics: Sequence[str], step: int,
    idle_ms: int = IDLE_MS, delay: str = "0 seconds",
) -> DataFrame:
    """Grid rows and late samples of a stream in one output, told apart by ``kind``.

    A sample at ``t`` (microseconds) releases all ticks before ``t``; the tick at ``t`` waits,
    since another topic may share the instant. It comes out when the sequence closes, ``idle_ms``
    of event time after its newest sample, and nothing of the sequence is kept. ``delay`` holds
    the watermark, and with it all closing, back.

    A sample at or before the last released tick, or before the watermark in a sequence that has
    no state, is late: it comes out as it is with how many microseconds it is behind. Every sample
    of a requested topic is either used or late. Rows without a sequence or time or with another
    topic are no samples but still move the watermark on. A null value is a sample: the topic has
    no value from there on.
    """
    names = list(topics)
    out = T.StructType([
        T.StructField(seq, samples.schema[seq].dataType),
        T.StructField("tick", T.LongType()),
        T.StructField(time, T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in names],
        T.StructField(KIND, T.StringType()),
        T.StructField(LATE_FIELDS[0], T.StringType()), T.StructField(LATE_FIELDS[1], T.DoubleType()), T.StructField(LATE_FIELDS[2], T.LongType()),
    ])
    wanted = F.col(seq).isNotNull() & F.col(topic).isin(names)
    columns = [seq, time, topic, value]
    return run_keyed(in_event_time(samples, time, delay, wanted, columns), seq, Hold(columns, names, step, idle_ms), out)


def ticks_of(tagged: DataFrame) -> DataFrame:
    """The grid rows of a tagged output."""
    return tagged.where(F.col(KIND) == TICK).drop(KIND, *LATE_FIELDS)


def late_of(tagged: DataFrame, seq: str, time: str) -> DataFrame:
    """The late samples of a tagged output: (sequence, time, topic, value, behind)."""
    topic, value, behind = LATE_FIELDS
    return tagged.where(F.col(KIND) == LATE).select(seq, time, F.col(topic).alias("topic"), F.col(value).alias("value"), behind)


def stream_hold_resample(
    samples: DataFrame, seq: str, time: str, topic: str, value: str, topics: Sequence[str], step: int,
    idle_ms: int = IDLE_MS, delay: str = "0 seconds",
) -> DataFrame:
    """Uniform grid with held values from a stream of samples, in append mode, without the late ones."""
    return ticks_of(stream_hold_tagged(samples, seq, time, topic, value, topics, step, idle_ms, delay))
