"""Projection of aligned source columns onto the canonical feature schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalars import binarize, column_or_missing, residual, to_number
from tickwise.functions.vectors import all_finite, array_first, array_mean
from tickwise.operators.align import finite_difference
from tickwise.operators.ordered import HotKeys, order_value, quoted
from tickwise.schema import CANONICAL, DERIVED, RESIDUAL, SourceSpec, spec_for

POSE_FIELDS = ("position.x", "position.y", "position.z",
               "orientation.x", "orientation.y", "orientation.z", "orientation.w")


def pose_columns(topic: str) -> list[str]:
    """Flattened column names of a pose topic, in canonical order."""
    return [f"{topic}.pose.{f}" for f in POSE_FIELDS]


def pose_fields(df: DataFrame, pose: str, out: Sequence[str]) -> DataFrame:
    """Unpack a pose struct column into seven columns."""
    return df.select(
        *[c for c in df.columns if c != pose],
        *[F.col(f"{pose}.{f}").alias(o) for f, o in zip(POSE_FIELDS, out)],
    )


def _gripper(df: DataFrame, spec: SourceSpec) -> Column:
    if spec.gripper not in df.columns:
        return F.lit(None).cast("double")
    raw = quoted(spec.gripper)
    if spec.gripper_reduce == "mean":
        raw = array_mean(raw)
    elif spec.gripper_reduce == "first":
        raw = array_first(raw)
    return binarize(to_number(raw), spec.gripper_threshold)


def project_canonical(df: DataFrame, dataset_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Source columns of one dataset to the eight canonical ones; a column it lacks is missing."""
    spec = spec_for(dataset_id)
    sources = dict(zip(CANONICAL[:7], pose_columns(spec.pose))) | spec.columns
    fields = []
    for name in CANONICAL:
        if name == "gripper_state":
            fields.append(_gripper(df, spec).alias(name))
        elif sources[name] in df.columns:
            fields.append(to_number(quoted(sources[name])).alias(name))
        else:
            fields.append(column_or_missing(df, sources[name]).alias(name))
    extra = []
    if spec.commanded in df.columns and spec.sensed in df.columns:
        extra.append(residual(quoted(spec.commanded), quoted(spec.sensed)).alias(RESIDUAL))
    return df.select(*map(quoted, keep), *fields, *extra)


def first_valid_vector(
    df: DataFrame, seq: str, order: Sequence[str], column: str, dim: int, out: str
) -> DataFrame:
    """Per sequence the first vector of exactly ``dim`` values in order; null if there is none.

    An aggregate with partial results on the map side, so a long sequence is no problem.
    """
    at = F.when(F.size(quoted(column)) == dim, order_value(order))
    return df.groupBy(seq).agg(F.min_by(quoted(column), at).alias(out))


def drop_incomplete(df: DataFrame, columns: Sequence[str] = CANONICAL) -> DataFrame:
    """Drop rows where any of the columns is null or NaN (infinity stays)."""
    return df.na.drop(subset=list(columns))


def drop_nonfinite(df: DataFrame, vector: str) -> DataFrame:
    """Drop rows whose vector has a null, NaN or infinite element."""
    return df.where(all_finite(F.col(vector)))


def add_derived(df: DataFrame, keys: Sequence[str], time: str, units_per_second: float = 1e9,
                order: Sequence[str] | None = None, hot: HotKeys | None = None) -> DataFrame:
    """The seven finite-difference features of the canonical ones."""
    return finite_difference(df, keys, time, DERIVED, units_per_second, order, hot)


def detect_width(df: DataFrame, vector: str, default: int = 16) -> DataFrame:
    """Largest vector width as a one-row table."""
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(default)).alias("width"))


def union_datasets(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all datasets under one schema; a column a part lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
