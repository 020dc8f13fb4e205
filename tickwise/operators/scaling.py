"""Per-channel normalisation and principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.vectors import all_finite, doubles, elements, standardise, vector

SMALL_STD = 1e-6
# Widest vector aggregated channel by channel in one expression list.
WIDE = 128
# Tasks per level of the tree that merges triangular factors.
MERGE_PARTS = (64, 8)
FACTOR = "part int, v array<double>"


def _safe_std(std: Column) -> Column:
    return F.when(std < SMALL_STD, 1.0).otherwise(std)


def _channels(
    df: DataFrame, column: str, width: int | None, aggs: Callable[[Column], dict[str, Column]]
) -> DataFrame:
    """Aggregates per channel as rows (channel, ...).

    With a known, moderate width every channel is its own aggregate over the array, so a row
    stays one row; otherwise the cells are expanded and combined before the shuffle.
    """
    v = F.col(column)
    if width is None or width > WIDE:
        if width is not None:
            # Exactly this many channels, as below: shorter vectors end in nulls.
            v = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col(column), i))
        cells = df.select(*[c for c in df.columns if c != column], F.posexplode(doubles(v)).alias("channel", "_x"))
        return cells.groupBy("channel").agg(*[e.alias(o) for o, e in aggs(F.col("_x")).items()])
    cells = F.array(*[F.struct(*[e.alias(o) for o, e in aggs(x).items()]) for x in elements(v, width)])
    return df.agg(cells.alias("_c")).select(F.posexplode("_c").alias("channel", "_s")).select("channel", "_s.*")


def fit_scaler(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """Mean and population deviation per channel; a tiny deviation becomes 1.

    Fit on window ticks, so that a tick under several windows counts several times.
    """
    stats = _channels(df.select(column), column, width, lambda x: {"mean": F.avg(x), "std": F.stddev_pop(x)})
    return stats.withColumn("std", _safe_std(F.col("std")))


def fit_scaler_sumsq(
    df: DataFrame, column: str, weight: str | None = None, width: int | None = None
) -> DataFrame:
    """The same from sums and sums of squares, variance clipped at 0.

    ``weight`` counts how often a row enters (its number of covering windows), which avoids
    materialising overlapping windows.
    """
    w = F.col("_w")
    rows = df.select(column, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    stats = _channels(
        rows, column, width, lambda x: {"_n": F.sum(F.when(x.isNotNull(), w)), "_s": F.sum(w * x), "_q": F.sum(w * x * x)})
    return (
        stats.withColumn("_n", F.when(F.col("_n") > 0, F.col("_n")))
        .withColumn("mean", F.col("_s") / F.col("_n"))
        .withColumn("_var", F.col("_q") / F.col("_n") - F.col("mean") * F.col("mean"))
        .withColumn("_var", F.when(F.col("_var") < 0, 0.0).otherwise(F.col("_var")))
        .select("channel", "mean", _safe_std(F.sqrt("_var")).alias("std"))
    )


def scaler_row(scaler: DataFrame) -> tuple[list[float], list[float]]:
    """Means and deviations in channel order; as many values as channels."""
    rows = scaler.orderBy("channel").collect()
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def apply_scaler(df: DataFrame, scaler: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Z-score a vector column with a fitted scaler; what is not finite becomes 0."""
    mean, std = scaler_row(scaler)
    return df.withColumn(out or column, standardise(F.col(column), vector(mean), vector(std)))


def scaler_table(streams: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Scalers of several vector columns as one table keyed by (stream, channel)."""
    parts = [s.select(F.lit(name).alias("stream"), "channel", "mean", "std") for name, s in streams]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _factor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the triangular QR factor of all rows seen: at most as many as columns."""
    r = None
    for batch in batches:
        if len(batch):
            m = np.stack(batch["v"].to_numpy())
            r = np.linalg.qr(m if r is None else np.vstack([r, m]), mode="r")
    if r is not None:
        yield pd.DataFrame({"part": TaskContext.get().partitionId(), "v": list(r)})


def pca_fit(df: DataFrame, column: str, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal components of vectors, each signed so that its largest loading is positive.

    Returns ``(loadings, explained variance ratios)`` with one column per component. Every task
    keeps only the triangular factor of the rows it has seen, factors are stacked and factored
    again in a tree, and one last task decomposes what is left; the driver gets ``components``
    vectors, never a square matrix. A leading column of ones takes the means out of the other
    columns, so vectors need not be centred. Vectors that are null or hold an element that is null
    or not finite take no part; without variance the ratios are 0.
    """
    v = doubles(F.col(column))
    rows = df.where(v.isNotNull() & all_finite(v)).select(F.concat(F.array(F.lit(1.0)), v).alias("v"))
    rows = rows.mapInPandas(_factor_rows, FACTOR)
    for parts in MERGE_PARTS:
        # By a column and without a number, so that adaptive execution joins small parts.
        rows = rows.repartition(F.pmod("part", F.lit(parts))).mapInPandas(_factor_rows, FACTOR)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for factor in _factor_rows(batches):
            whole = np.stack(factor["v"].to_numpy())
            centred = whole[1:, 1:]
            width = centred.shape[1]
            if not 0 < components <= width:
                raise ValueError(f"{components} components of vectors of width {width}")
            square = np.vstack([centred, np.zeros((max(0, width - len(centred)), width))])
            _, spread, axes = np.linalg.svd(square)
            # What rounding leaves of equal vectors is no variance.
            if spread[0] <= 8 * np.finfo(float).eps * np.linalg.norm(whole):
                spread[:] = 0
            share = spread**2 / max((spread**2).sum(), np.finfo(float).tiny)
            yield pd.DataFrame(
                {"component": range(components), "loading": list(axes[:components]), "explained": share[:components]})

    found = rows.repartition(1).mapInPandas(decompose, "component int, loading array<double>, explained double")
    found = found.orderBy("component").collect()
    if not found:
        raise ValueError(f"no complete vector in {column}")
    loadings = np.array([r["loading"] for r in found]).T
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return loadings * np.where(top < 0, -1.0, 1.0), np.array([r["explained"] for r in found])


def pca_apply(df: DataFrame, loadings: np.ndarray, column: str, out: str) -> DataFrame:
    """Project centred vectors onto the loadings, one inner product per component."""
    parts = [
        F.aggregate(
            F.zip_with(doubles(F.col(column)), vector(loadings[:, j]), lambda x, w: x * w),
            F.lit(0.0),
            lambda s, x: s + x,
        )
        for j in range(loadings.shape[1])
    ]
    return df.withColumn(out, F.array(*parts))


def pca_table(loadings: np.ndarray, ratios: np.ndarray, spark) -> DataFrame:
    """Components as rows (component, channel, loading, explained)."""
    rows = [
        (j, i, float(loadings[i, j]), float(ratios[j]))
        for j in range(loadings.shape[1])
        for i in range(loadings.shape[0])
    ]
    return spark.createDataFrame(rows, "component int, channel int, loading double, explained double")

