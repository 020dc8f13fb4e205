"""Sliding windows over ticks, and bags of windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.vectors import all_finite, doubles, fit_width
from tickwise.operators.lookup import join_facts, join_lookup, with_group_facts
from tickwise.operators.ordered import HotKeys, ordered_scan
from tickwise.operators.ranges import explode_range


def covering_windows(index: str, length: int, stride: int) -> Column:
    """Numbers of all windows that cover a 0-based position (empty array between windows)."""
    first = f"greatest(0L, (`{index}` - {length} + {stride}) div {stride})"
    last = f"`{index}` div {stride}"
    return F.expr(f"if({first} <= {last}, sequence({first}, {last}), array())")


def window_ticks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int, columns: Sequence[str],
    index: str | None = None, hot: HotKeys | None = None,
) -> DataFrame:
    """One row per (window, tick): window number, offset in the window and the tick's columns.

    Only complete windows are kept; a sequence shorter than one window has none. Ticks are
    numbered by a scan unless ``index`` names a gap-free 0-based position already there.
    """
    keys = list(keys)
    if index is None:
        df = ordered_scan(df, keys, order, index="_i", count="_n", hot=hot)
    else:
        size = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
        df = join_facts(df.withColumn("_i", F.col(index).cast("long")), size, keys, hot=hot)
    return (
        df.select(*keys, *columns, "_i", "_n", F.explode(covering_windows("_i", length, stride)).alias("window"))
        .where(F.col("window") * stride + length <= F.col("_n"))
        .select(*keys, "window", (F.col("_i") - F.col("window") * stride).alias("offset"), *columns)
    )


def sliding_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int, label: str,
    aggs: Mapping[str, Column] | None = None, hot: HotKeys | None = None,
) -> DataFrame:
    """One row per complete window: start, label = max over the window, and any aggregates."""
    keys = list(keys)
    used = [c for c in df.columns if c not in keys]
    ticks = window_ticks(df, keys, order, length, stride, used, hot=hot)
    return (
        ticks.groupBy(*keys, "window")
        .agg(F.max(label).alias("y"), *[e.alias(o) for o, e in (aggs or {}).items()])
        .withColumn("start", F.col("window") * stride)
    )


def clean_vectors(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Fit every vector to ``width`` and drop rows that are not finite within it."""
    v = F.col(vector)
    inside = F.when(F.size(v) > width, F.slice(v, 1, width)).otherwise(v)
    return df.where(all_finite(inside)).withColumn(vector, fit_width(v, width))


def windows_by_split(
    df: DataFrame, split: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int,
    label: str, vector: str, width: int, aggs: Mapping[str, Column] | None = None,
    hot: HotKeys | None = None, name: str | None = None,
) -> DataFrame:
    """Windows of the sequences listed in ``split``, after fitting widths and dropping bad rows.

    With ``name``, a column of ``split``, one pass cuts the windows of all splits and says in that
    column which one a window belongs to; a sequence must then stand in one split only.
    """
    if name is None:
        chosen = join_facts(df, split.select(*keys).distinct(), keys, "left_semi", hot)
        aggs = dict(aggs or {})
    else:
        chosen = join_facts(df, split.select(*keys, name).distinct(), keys, "inner", hot)
        aggs = {**(aggs or {}), name: F.min(name)}
    return sliding_windows(clean_vectors(chosen, vector, width), keys, order, length, stride, label, aggs, hot)


def build_bags(windows: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """One header row per bag: label = largest window label, and the number of windows.

    The windows themselves stay rows keyed by (bag, window); packing a bag into one array
    would put an unbounded group into one row.
    """
    return windows.groupBy(*keys).agg(F.max(y).cast("double").alias("bag_label"), F.count(F.lit(1)).alias("n_windows"))


def tail_keep(n: Column, fraction: Column | float) -> Column:
    """Windows kept of a tail-filtered bag: ``max(1, round(f * n))``, half to even."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1).cast("long"), F.bround(f * n, 0).cast("long"))


def bag_tail_filter(
    windows: DataFrame, keys: Sequence[str], window: str, y: str, dataset: str,
    fractions: Mapping[str, float], only_label: int | None = 1,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Keep only the last windows of bags of the listed datasets.

    Bag label and size are taken before filtering. With ``only_label=1`` just failure bags
    are cut, also in evaluation data, which shows the scorer something the true label
    decides; ``None`` cuts every bag of the dataset. Window numbers must be 0..n-1.
    """
    rows = with_group_facts(
        windows, keys, {"bag_label": F.max(F.col(y).cast("double")), "n_windows": F.count(F.lit(1))}, hot)
    fraction = F.lit(1.0)
    for name, f in fractions.items():
        fraction = F.when(F.col(dataset) == name, F.lit(float(f))).otherwise(fraction)
    applies = fraction < 1.0
    if only_label is not None:
        applies = applies & ((F.col("bag_label") > 0.5) == F.lit(bool(only_label)))
    kept = F.when(applies, F.least(tail_keep(F.col("n_windows"), fraction), F.col("n_windows"))).otherwise(
        F.col("n_windows")
    )
    return rows.withColumn("n_kept", kept).where(F.col(window) >= F.col("n_windows") - F.col("n_kept"))


def tail_filter_stats(filtered: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Bags the tail filter shortened, and their mean size before and after."""
    bags = filtered.groupBy(*group, *keys).agg(
        F.max("n_windows").alias("_before"), F.max("n_kept").alias("_after")
    )
    cut = F.col("_after") < F.col("_before")
    return bags.groupBy(*group).agg(
        F.count_if(cut).alias("bags_filtered"),
        F.coalesce(F.avg(F.when(cut, F.col("_before"))), F.lit(0.0)).alias("avg_len_before"),
        F.coalesce(F.avg(F.when(cut, F.col("_after"))), F.lit(0.0)).alias("avg_len_after"),
    )


def bag_attributes(
    bags: DataFrame, instructions: DataFrame, keys: Sequence[str], vector: str, dim: int, null_flag: Column
) -> DataFrame:
    """Attach the instruction vector (zeros when absent) and the null-token flag to bag headers."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    joined = bags.join(instructions.select(*keys, F.col(vector).alias("_v")), list(keys), "left")
    return joined.select(
        *bags.columns, F.coalesce(doubles(F.col("_v")), zeros).alias(vector), null_flag.alias("use_null")
    )


def pad_bags(
    windows: DataFrame, bags: DataFrame, keys: Sequence[str], batch: str, window: str, vector: str, width: int,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Pad the bags of a batch to the longest one, with a validity mask.

    Output is one row per (bag, position): real windows first, then zero vectors. ``bags``
    carries ``batch`` and ``n_windows``; windows are numbered 0..n-1.
    """
    longest = bags.groupBy(batch).agg(F.max("n_windows").alias("_m"))
    headed = join_lookup(bags.select(*keys, batch, "n_windows"), longest, batch, "inner")
    gaps = headed.where("n_windows < _m").withColumn("_last", F.col("_m") - 1)
    # A long bag makes its whole batch long: those rows are redistributed block by block.
    missing = explode_range(
        gaps, "n_windows", "_last", window, [*keys, batch], keys if hot else None
    ).withColumns({vector: F.array_repeat(F.lit(0.0), width), "valid": F.lit(0)})
    real = join_facts(windows, bags.select(*keys, batch), keys, hot=hot).select(
        *keys, batch, F.col(window).cast("long").alias(window), doubles(F.col(vector)).alias(vector),
        F.lit(1).alias("valid"),
    )
    return real.unionByName(missing)


def coverage(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int, stride: int, out: str = "n_windows",
    hot: HotKeys | None = None,
) -> DataFrame:
    """How many complete windows cover each tick, without building the windows."""
    scanned = ordered_scan(df, keys, order, index="_i", count="_n", hot=hot)
    first = F.expr(f"greatest(0L, (_i - {length} + {stride}) div {stride})")
    last = F.expr(f"least(_i div {stride}, (_n - {length}) div {stride})")
    covered = F.when(F.col("_n") < length, F.lit(0).cast("long")).otherwise(
        F.greatest(last - first + 1, F.lit(0).cast("long"))
    )
    return scanned.select(*df.columns, covered.alias(out))
