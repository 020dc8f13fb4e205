"""Pooling of instance vectors into one vector per bag.

Instances are rows (bag, idx, vector). Pooling gives one row (bag, z) per bag and the instance
weights as rows (bag, idx, weight), so no bag is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.vectors import dot, elements, vector
from tickwise.operators.lookup import join_facts, with_group_facts
from tickwise.operators.ordered import HotKeys, hot_keys

POOL_MODES = ("gated", "max", "mean")
# exp() of a logit shifted by its own bound stays in double range up to here.
SAFE_LOGIT_BOUND = 300.0
# Logits of one level differ by less than this, so their exponentials add up without overflow.
LEVEL = 256.0


def gated_logit(column: Column, V: np.ndarray, U: np.ndarray, w: np.ndarray) -> Column:
    """``w . (tanh(V h) * sigmoid(U h))`` per row, in Arrow batches: a matrix product per batch
    beats nested array expressions by far at the usual 128 hidden units."""
    V, U, w = np.asarray(V, float), np.asarray(U, float), np.asarray(w, float)

    @F.pandas_udf("double")
    def logit(h: pd.Series) -> pd.Series:
        if len(h) == 0:
            return pd.Series([], dtype=float)
        m = np.stack(h.to_numpy()).astype(float)
        return pd.Series((np.tanh(m @ V.T) * (1.0 / (1.0 + np.exp(-(m @ U.T))))) @ w)

    return logit(column)


def vector_agg(df: DataFrame, bag: str, column: str, width: int, agg: Callable[[Column], Column], out: str) -> DataFrame:
    """Aggregate every dimension of a vector column per bag: one row per bag, no row per cell."""
    return df.groupBy(bag).agg(F.array(*[agg(x) for x in elements(F.col(column), width)]).alias(out))


def _online_softmax(df: DataFrame, bag: str, logit: str, column: str, width: int) -> DataFrame:
    """Softmax-weighted mean per bag in one pass, whatever the size of the logits.

    Exponentials are taken within levels of the logit and summed per (bag, level) before the
    shuffle; the few levels of a bag are then rescaled to its highest one and added up.
    """
    level = F.floor(F.col(logit) / LEVEL)
    e = F.exp(F.col(logit) - level * LEVEL)
    parts = df.withColumns({"_level": level, "_e": e}).groupBy(bag, "_level").agg(
        F.sum("_e").alias("s"), F.array(*[F.sum(F.col("_e") * x) for x in elements(F.col(column), width)]).alias("v"))
    of_bag = parts.groupBy(bag).agg(
        F.collect_list(F.struct(F.col("_level").cast("double").alias("level"), "s", "v")).alias("_parts"), F.max("_level").cast("double").alias("_top"))

    def scale(p: Column) -> Column:
        return F.exp((p["level"] - F.col("_top")) * LEVEL)

    total = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["s"] * scale(p))
    summed = F.aggregate(
        "_parts", F.array(*[F.lit(0.0)] * width), lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * scale(p)))
    return of_bag.select(bag, total.alias("_total"), summed.alias("_v")).select(
        bag, F.transform("_v", lambda x: x / F.col("_total")).alias("z"))


def _instance_weights(df: DataFrame, bag: str, idx: str, logit: str, hot: HotKeys | None, bound: float | None = None) -> DataFrame:
    """Softmax over the instances of each bag. Only ids and logits are shuffled, once unless a bag is hot."""
    rows = df.select(bag, idx, logit)
    if hot is None:
        hot = hot_keys(df, [bag])
    if bound is None:
        rows = with_group_facts(rows, [bag], {"_shift": F.max(logit)}, hot)
    else:
        rows = rows.withColumn("_shift", F.lit(float(bound)))
    rows = rows.withColumn("_e", F.exp(F.col(logit) - F.col("_shift")))
    return with_group_facts(rows, [bag], {"_total": F.sum("_e")}, hot).select(bag, idx, (F.col("_e") / F.col("_total")).alias("weight"))


def pool_gated_attention(
    df: DataFrame, bag: str, idx: str, column: str, width: int, V: np.ndarray, U: np.ndarray, w: np.ndarray,
    valid: Column | None = None, hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Gated attention pooling for given weights; returns (pooled, instance weights).

    The gate keeps every logit within ``sum |w|``, so the softmax is shifted by that bound
    and needs no pass for the largest logit of each bag. Each result scans the rows and runs the
    gate once.
    """
    rows = df if valid is None else df.where(valid)
    scored = rows.withColumn("_logit", gated_logit(F.col(column), V, U, w))
    bound = float(np.abs(w).sum())
    if bound > SAFE_LOGIT_BOUND:
        return _online_softmax(scored, bag, "_logit", column, width), _instance_weights(scored, bag, idx, "_logit", hot)
    shifted = scored.withColumn("_e", F.exp(F.col("_logit") - F.lit(bound)))
    pooled = vector_agg(shifted, bag, column, width, lambda x: F.sum(F.col("_e") * x) / F.sum("_e"), "z")
    return pooled, _instance_weights(scored, bag, idx, "_logit", hot, bound)


def pool_attention(
    df: DataFrame, bag: str, idx: str, column: str, weight: Sequence[float], bias: float = 0.0,
    valid: Column | None = None, hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Softmax pooling with one linear score; returns (pooled, instance weights), a scan each."""
    rows = df if valid is None else df.where(valid)
    scored = rows.withColumn("_logit", dot(F.col(column), vector(weight)) + F.lit(bias))
    return _online_softmax(scored, bag, "_logit", column, len(weight)), _instance_weights(scored, bag, idx, "_logit", hot)


def last_readout(df: DataFrame, bag: str, idx: str, column: str) -> DataFrame:
    """The vector of the last instance of every bag."""
    return df.groupBy(bag).agg(F.max_by(column, idx).alias(column))


def pool_max(
    df: DataFrame, bag: str, idx: str, column: str, width: int, valid: Column | None = None,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Largest value per dimension, and the share of dimensions each instance wins.

    Of equal values the lowest ``idx`` wins. Instances that win nothing, or are not valid, have
    share 0. The first holders of the maxima are one row per bag, joined to
    the ids of its instances; no vector is shuffled.
    """
    ok = F.lit(True) if valid is None else valid
    pooled = (df if valid is None else df.where(valid)).transform(lambda d: vector_agg(d, bag, column, width, F.max, "z"))
    first = [F.struct((-x).alias("x"), F.col(idx).alias("i")) for x in elements(F.col(column), width)]
    holders = df.groupBy(bag).agg(F.array(*[F.min(F.when(ok, f))["i"] for f in first]).alias("_holders"))
    held = join_facts(df.select(bag, idx), holders, [bag], hot=hot)
    won = F.size(F.filter("_holders", lambda i: i == F.col(idx)))
    return pooled, held.select(bag, idx, (won / F.lit(width)).alias("weight"))


def pool_mean(
    df: DataFrame, bag: str, idx: str, column: str, width: int, valid: Column | None = None,
    hot: HotKeys | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mean over valid instances, and uniform weights over them (0 on the others)."""
    flagged = df.withColumn("_ok", F.lit(True) if valid is None else valid)
    count = F.greatest(F.count_if("_ok"), F.lit(1))
    pooled = vector_agg(
        flagged, bag, column, width,
        lambda x: F.coalesce(F.sum(F.when(F.col("_ok"), x)), F.lit(0.0)) / count, "z")
    sized = with_group_facts(flagged.select(bag, idx, "_ok"), [bag], {"_m": F.count_if("_ok")}, hot)
    weights = sized.select(
        bag, idx, F.when(F.col("_ok"), F.lit(1.0) / F.greatest("_m", F.lit(1))).otherwise(0.0).alias("weight"))
    return pooled, weights


def pool(
    df: DataFrame, mode: str, bag: str, idx: str, column: str, width: int, **params
) -> tuple[DataFrame, DataFrame]:
    """Pool with one of the modes ``gated``, ``max``, ``mean``."""
    if mode not in POOL_MODES:
        raise ValueError(f"pool mode must be one of {'/'.join(POOL_MODES)}, got {mode!r}")
    run = {"gated": pool_gated_attention, "max": pool_max, "mean": pool_mean}[mode]
    return run(df, bag, idx, column, width, **params)
