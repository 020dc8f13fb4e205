"""Array column functions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def doubles(v: Column) -> Column:
    """The same vector in double precision."""
    return v.cast("array<double>")


def elements(v: Column, width: int) -> list[Column]:
    """The first ``width`` elements as double columns, cast one by one."""
    return [F.get(v, F.lit(i)).cast("double") for i in range(width)]


def array_mean(v: Column) -> Column:
    """Mean of the elements; a null or empty array is missing."""
    d = doubles(v)
    return F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), F.size(d))


def array_first(v: Column) -> Column:
    """First element; a null or empty array is missing."""
    return F.get(v, F.lit(0))


def all_finite(v: Column) -> Column:
    """True when no element is null, NaN (which sorts above infinity) or infinite."""
    return F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def fit_width(v: Column, width: int) -> Column:
    """Zero-pad or clip to exactly ``width`` elements."""
    padded = F.concat(doubles(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(v), F.lit(0))))
    return F.when(F.size(v) == width, doubles(v)).otherwise(F.slice(padded, 1, width))


def standardise(v: Column, mean: Column, std: Column) -> Column:
    """``(v - mean) / std`` per element, 0 where the result is not finite."""
    centred = F.zip_with(doubles(v), mean, lambda x, m: x - m)
    scaled = F.zip_with(centred, std, lambda x, s: F.try_divide(x, s))
    return F.transform(
        scaled,
        lambda x: F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(0.0),
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first element on."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mix(a: Column, b: Column, lam: Column) -> Column:
    """``lam * a + (1 - lam) * b`` per element."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: lam * x + (F.lit(1.0) - lam) * y)


def film(z: Column, gamma: Column, beta: Column) -> Column:
    """``(1 + gamma) * z + beta`` per dimension."""
    scaled = F.zip_with(doubles(z), doubles(gamma), lambda x, g: (F.lit(1.0) + g) * x)
    return F.zip_with(scaled, doubles(beta), lambda x, b: x + b)


def route_instruction(nl: Column, use_null: Column, null_vector: Column) -> Column:
    """The instruction vector, or the default one where flagged or missing."""
    return F.when(use_null | nl.isNull(), null_vector).otherwise(doubles(nl))
