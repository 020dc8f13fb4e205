"""Time alignment: many topics at their own rates onto one uniform grid, and series operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.lookup import join_facts
from tickwise.operators.ordered import CHUNK, HotKeys, hot_keys, ordered_scan, quoted, split_hot
from tickwise.operators.ranges import explode_range

def sparse_pivot(
    samples: DataFrame, seq: str, time: str, topic: str, value: str, topics: Mapping[str, str], also: Sequence[str] = ()
) -> DataFrame:
    """One wide row per instant. ``topics`` maps topic name to output column.

    The topic list is given, so no pass is spent on finding it. Of two samples of one topic
    at the same instant the larger value is kept, which makes the result reproducible.
    """
    wide = (
        samples.where(F.col(topic).isin(list(topics)))
        .groupBy(seq, *also, time)
        .agg(*[F.max(F.when(F.col(topic) == t, F.col(value))).alias(c) for t, c in topics.items()])
    )
    return wide


def time_chunks(
    samples: DataFrame, seq: str, time: str, length: int, out: str = "chunk", hot: HotKeys | None = None
) -> DataFrame:
    """Number the fixed-length chunks of every sequence from its first sample on."""
    start = samples.groupBy(seq).agg(F.min(time).alias("_t0"))
    return join_facts(samples, start, [seq], hot=hot).withColumn(
        out, F.expr(f"(`{time}` - _t0) div {int(length)}")
    ).drop("_t0")


def _with_ticks(
    held: DataFrame, seq: str, time: str, step: int, columns: Sequence[str], long_grids: bool
) -> DataFrame:
    """Emit, for every held row, the grid ticks from its instant up to the next row."""
    k0 = F.expr(f"(`{time}` - _t0 + {step - 1}) div {step}")
    k1 = F.expr(f"(_next - _t0 + {step - 1}) div {step} - 1")
    on_grid = F.expr(f"(`{time}` - _t0) % {step} = 0")
    bounds = held.withColumn("_k0", k0).withColumn(
        "_k1", F.when(F.col("_next").isNull(), F.when(on_grid, F.col("_k0")).otherwise(F.col("_k0") - 1)).otherwise(k1)
    )
    ticks = explode_range(
        bounds.where("_k1 >= _k0"), "_k0", "_k1", "tick", [seq, "_t0", *columns], [seq] if long_grids else None)
    return ticks.select(seq, "tick", (F.col("_t0") + F.col("tick") * F.lit(step)).alias(time), *columns)


def _splits(
    samples: DataFrame, seq: str, time: str, step: int, hot: HotKeys | None
) -> tuple[HotKeys, bool]:
    """Sequences with many samples, and whether any has a long grid: one pass unless one does."""
    rows, span = F.count(F.lit(1)), (F.max(time) - F.min(time)) / F.lit(step) + 1
    large = hot_keys(samples, [seq], F.greatest(rows.cast("double"), span))
    if not large:
        return large, False
    return (hot if hot is not None else hot_keys(samples, [seq])), bool(grid_hot_keys(samples, seq, time, step))


def hold_resample(
    samples: DataFrame,
    seq: str,
    time: str,
    topic: str,
    value: str,
    topics: Mapping[str, str],
    step: int,
    hot: HotKeys | None = None,
) -> DataFrame:
    """All topics of a sequence on a uniform integer-time grid, last value carried forward.

    The grid starts at the first sample of any requested topic and ends at or before the
    last one; a topic is null before its first sample. Every held interval emits its own
    ticks, so no grid is built and joined: one shuffle by (sequence, chunk) covers the pivot,
    the carry and the look-ahead. Very long sequences are cut into chunks first.
    """
    wanted = samples.where(F.col(topic).isin(list(topics))).select(seq, topic, time, value)
    hot, long_grids = _splits(wanted, seq, time, step, hot)
    chunked, split = split_hot(wanted, [seq], [time], hot)
    return _hold(
        chunked, seq, time, topic, value, topics, step, CHUNK if split is not None else None, long_grids, split)


def hold_resample_chunked(
    samples: DataFrame,
    seq: str,
    time: str,
    topic: str,
    value: str,
    topics: Mapping[str, str],
    step: int,
    chunk_length: int,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``hold_resample`` computed over fixed-length time chunks with the held values carried."""
    wanted = samples.where(F.col(topic).isin(list(topics))).select(seq, topic, time, value)
    hot, long_grids = _splits(wanted, seq, time, step, hot)
    chunked = time_chunks(wanted, seq, time, chunk_length, CHUNK, hot)
    return _hold(chunked, seq, time, topic, value, topics, step, CHUNK, long_grids)


def hold_resample_wide(
    sparse: DataFrame, seq: str, time: str, columns: Sequence[str], step: int, hot: HotKeys | None = None
) -> DataFrame:
    """The same from an already wide, sparse frame whose columns may have any orderable type."""
    hot, long_grids = _splits(sparse.select(seq, time), seq, time, step, hot)
    chunked, split = split_hot(sparse.select(seq, time, *map(quoted, columns)), [seq], [time], hot)
    group = [seq, CHUNK] if split is not None else [seq]
    # Columns get short names meanwhile, since source names hold dots and slashes.
    short = {f"_v{i}": c for i, c in enumerate(columns)}
    merged = (
        chunked.repartition(*group)
        .groupBy(*group, time)
        .agg(*[F.max(quoted(c)).alias(v) for v, c in short.items()])
    )
    held = _held(merged, seq, time, list(short), CHUNK if split is not None else None, split)
    ticks = _with_ticks(held, seq, time, step, list(short), long_grids)
    return ticks.select(seq, "tick", time, *[F.col(v).alias(c) for v, c in short.items()])


def _hold(
    chunked, seq, time, topic, value, topics, step, chunk: str | None, long_grids: bool,
    split_keys: DataFrame | None = None,
) -> DataFrame:
    group = [seq, chunk] if chunk else [seq]
    # Hash partitioning by the group also serves the finer (group, time) aggregate.
    placed = chunked.repartition(*group)
    wide = sparse_pivot(placed, seq, time, topic, value, topics, also=group[1:])
    columns = list(topics.values())
    return _with_ticks(_held(wide, seq, time, columns, chunk, split_keys), seq, time, step, columns, long_grids)


def _held(
    wide: DataFrame, seq: str, time: str, columns: list[str], chunk: str | None, split_keys: DataFrame | None
) -> DataFrame:
    """Carry every column forward and look one row ahead, in one sort."""
    return ordered_scan(
        wide,
        [seq],
        [time],
        last={f"_held_{c}": c for c in columns},
        lead={"_next": time},
        head={"_t0": time},
        chunk=chunk,
        split_keys=split_keys,
    ).select(seq, time, "_t0", "_next", *[F.col(f"_held_{c}").alias(c) for c in columns])


def fill_both(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str], hot: HotKeys | None = None
) -> DataFrame:
    """Forward fill, then backward fill what is left. ``columns`` is ``{output: input}``.

    Only rows before the first value are left after the forward fill, and what they take is
    that first value: no window over following rows is needed.
    """
    scanned = ordered_scan(
        df,
        keys,
        order,
        last={f"_fw_{o}": c for o, c in columns.items()},
        first_valid={f"_bw_{o}": c for o, c in columns.items()},
        hot=hot,
    )
    filled = [F.coalesce(f"_fw_{o}", f"_bw_{o}").alias(o) for o in columns]
    return scanned.select(*[quoted(c) for c in df.columns if c not in columns], *filled)


def finite_difference(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Mapping[str, str],
    units_per_second: float = 1e9,
    order: Sequence[str] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Rate of change per second; 0 in the first row, where dt <= 0 or a value is missing.

    ``order`` defaults to the time column. Give a tick column where clocks may step back.
    """
    scanned = ordered_scan(
        df, keys, order or [time], lag={"_t": time, **{f"_p_{o}": c for o, c in columns.items()}}, hot=hot
    )
    dt = (F.col(time) - F.col("_t")) / F.lit(float(units_per_second))
    rates = [
        F.coalesce(
            F.when(dt > 0, F.nanvl((F.col(c) - F.col(f"_p_{o}")) / dt, F.lit(None).cast("double"))), F.lit(0.0)
        ).alias(o)
        for o, c in columns.items()
    ]
    return scanned.select(*map(quoted, df.columns), *rates)


def linear_interp_trace(
    positions: DataFrame, trace: DataFrame, seq: str, x: str, n: str, p: str, warm_up: int, out: str = "p_at",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Trace value at a fractional window count, clamped at the warm-up and at the end.

    ``trace`` holds one value per window count ``n`` from ``warm_up`` to the last; a sequence
    without any gives 0, and so does a null position. Positions and trace are merged in the order of
    the count and scanned once: a trace value stands at its own count as the lower neighbour and one
    count earlier as the upper one, so both neighbours of a position are the last ones seen. Before
    the warm-up the first of each counts.
    """
    at = F.col(n).cast("long")
    here = F.struct(at.cast("double").alias("_at"), F.col(p).alias("_lo"), F.lit(None).cast("double").alias("_hi"))
    ahead = F.struct((at - 1).cast("double").alias("_at"), F.lit(None).cast("double").alias("_lo"), F.col(p).alias("_hi"))
    marks = trace.where((at >= warm_up) & F.col(p).isNotNull()).select(
        quoted(seq), F.explode(F.when(at > warm_up, F.array(here, ahead)).otherwise(F.array(here))).alias("_m"))
    marks = marks.select(quoted(seq), "_m.*", F.lit(0).alias("_kind"))
    asked = positions.select(
        quoted(seq), F.struct(*map(quoted, positions.columns)).alias("_row"), F.col(x).cast("double").alias("_at"),
        F.lit(1).alias("_kind"))
    merged = ordered_scan(
        asked.unionByName(marks, allowMissingColumns=True), [seq], ["_at", "_kind"],
        last={"_l": "_lo", "_h": "_hi"}, first_valid={"_l0": "_lo", "_h0": "_hi"}, hot=hot,
    ).where("_kind = 1")
    low = F.coalesce("_l", "_l0")
    high = F.coalesce("_h", "_h0", "_l0")
    w = F.when(low == high, 0.0).otherwise(F.col("_at") - F.floor("_at"))
    value = F.when(F.col("_at").isNotNull(), (F.lit(1.0) - w) * low + w * high)
    return merged.select("_row.*", F.coalesce(value, F.lit(0.0)).alias(out))


def fractional_resample(
    series: DataFrame, lengths: DataFrame, seq: str, idx: str, length: str, outputs: int, offset: int = 0
) -> DataFrame:
    """Map ``outputs`` steps onto each series by progress fraction, nearest index half to even.

    ``series`` has a 0-based ``idx``; ``lengths`` one row per sequence with its ``length``.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(outputs - 1)))
    span = F.col(length) - 1 - offset
    wanted = lengths.select(seq, F.col(length), k.alias("k")).select(
        seq,
        "k",
        F.greatest(
            F.lit(0).cast("long"),
            F.least(
                F.lit(offset) + F.bround(F.col("k") / F.lit(float(max(outputs - 1, 1))) * span, 0).cast("long"),
                F.col(length) - 1,
            ),
        ).alias(idx),
    )
    return wanted.join(series, [seq, idx])


def jump_segment(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, anchors: DataFrame, anchor: str,
    threshold: float, min_length: int, hot: HotKeys | None = None,
) -> DataFrame:
    """The rows of the jump-free segment around an anchor position, per key.

    A new segment starts where the absolute step exceeds ``threshold``. ``anchors`` has one
    0-based position per key, clamped to the series. A segment shorter than ``min_length``
    is replaced by the rows from ``anchor - min_length`` up to ``anchor + min_length``.
    """
    keys, order = list(keys), list(order)
    if hot is None:
        hot = hot_keys(df, keys)
    at = anchors.select(*map(quoted, keys), F.col(anchor).cast("long").alias("_anchor"))
    chunked, split = split_hot(join_facts(df, at, keys, hot=hot), keys, order, hot)
    scan = {"chunk": CHUNK if split is not None else None, "split_keys": split}
    # Three scans of one partitioning: positions and jumps, segment numbers and the anchor's segment, its bounds.
    stepped = ordered_scan(chunked, keys, order, index="idx", count="_n", lag={"_prev": value}, **scan)
    centre = F.greatest(F.lit(0).cast("long"), F.least("_anchor", F.col("_n") - 1))
    jump = F.when(F.abs(F.col(value) - F.col("_prev")) > threshold, 1).otherwise(0)
    numbered = ordered_scan(
        stepped.withColumns({"_c": centre, "_jump": jump, "_passed": F.when(F.col("idx") <= centre, jump).otherwise(0)}),
        keys, order, sums={"segment": "_jump"}, totals={"_held": "_passed"}, **scan)
    bounded = ordered_scan(
        numbered.withColumns({
            "_under": F.when(F.col("segment") < F.col("_held"), 1).otherwise(0),
            "_upto": F.when(F.col("segment") <= F.col("_held"), 1).otherwise(0)}),
        keys, order, totals={"_lo": "_under", "_hi": "_upto"}, **scan)
    short = (F.col("_hi") - F.col("_lo")) < min_length
    first = F.when(short, F.greatest(F.lit(0), F.col("_c") - min_length)).otherwise(F.col("_lo"))
    end = F.when(short, F.least(F.col("_n"), F.col("_c") + min_length)).otherwise(F.col("_hi"))
    return bounded.where((F.col("idx") >= first) & (F.col("idx") < end)).select(
        *map(quoted, df.columns), "idx", "segment")


def grid_hot_keys(samples: DataFrame, seq: str, time: str, step: int) -> HotKeys:
    """Sequences whose grid is long, from the first and last sample alone."""
    return hot_keys(samples, [seq], (F.max(time) - F.min(time)) / F.lit(step) + 1)


def step_seconds(hz: float, units_per_second: int = 1_000_000_000) -> int:
    """Grid step in integer time units for a rate."""
    return int(round(units_per_second / hz))


def micros(ts: Column) -> Column:
    """A zone-less timestamp as integer microseconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)
