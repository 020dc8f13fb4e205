"""Scalar column functions: coercion, binarising, names, label and alert arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.schema import spec_for


def missing_to_null(c: Column) -> Column:
    """NaN becomes null: Spark orders NaN above every number, the rules here do not."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def to_number(c: Column) -> Column:
    """Text or any scalar to double; what does not parse is missing."""
    return missing_to_null(c.try_cast("double"))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def column_or_missing(df: DataFrame, name: str, dtype: str = "double") -> Column:
    """The column, or a missing one where this source has none."""
    return F.col(f"`{name}`").cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def binarize(c: Column, threshold: Column | float) -> Column:
    """1 above the threshold (strict), 0 otherwise, missing where the value is not finite."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(is_finite(c), F.when(c > thr, 1.0).otherwise(0.0))


def binarize_for(dataset_id: str, c: Column) -> Column:
    """Binarise with the threshold registered for a dataset; an unknown dataset is an error."""
    return binarize(c, spec_for(dataset_id).gripper_threshold)


def residual(commanded: Column, sensed: Column) -> Column:
    """Commanded minus sensed, 0 where either is missing."""
    return F.coalesce(to_number(commanded) - to_number(sensed), F.lit(0.0))


def label_smooth(y: Column, s: float) -> Column:
    """Pull a 0/1 target towards the other class by ``s``."""
    return y * (1.0 - s) + (F.lit(1.0) - y) * s


def sigmoid(x: Column) -> Column:
    """Logit to probability."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def alert_level(p: Column, threshold: Column | float) -> Column:
    """``safe`` below half the threshold, ``warn`` below it, ``alarm`` from it on."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(p < thr * 0.5, "safe").when(p < thr, "warn").otherwise("alarm")


def alert_ramp(p: Column, threshold: Column | float) -> Column:
    """Position inside the warn band: 0 when safe, 1 when in alarm, linear between."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    half = thr * 0.5
    return F.when(p < half, 0.0).when(p < thr, (p - half) / half).otherwise(1.0)


def duration_seconds(ticks: Column, fps: float) -> Column:
    """Ticks to seconds with one decimal, half to even."""
    return F.bround(ticks / F.lit(float(fps)), 1)


def safe_name(c: Column) -> Column:
    """A sequence name usable as one path element."""
    return F.translate(c, "/\\", "__")


def file_stem(name: Column, prefix: str) -> Column:
    """File stem of ``<prefix><stem>_ep<episode>``."""
    stem = F.regexp_extract(name, r"^(.*?)_ep", 1)
    return F.replace(F.when(F.contains(name, F.lit("_ep")), stem).otherwise(name), F.lit(prefix), F.lit(""))


def episode_id(name: Column) -> Column:
    """Episode number after the last ``_ep``."""
    return F.substring_index(name, "_ep", -1).try_cast("long")


def md5_key(seed: int, name: Column) -> Column:
    """Reproducible shuffle key of a name."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name.cast("string")))


def md5_uniform(key: Column) -> Column:
    """Uniform draw in [0, 1) from the first 8 hex digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
