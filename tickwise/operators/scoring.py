"""Scoring, losses, augmentation, payload encoding and a distributed bag classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.functions.scalars import label_smooth, md5_key, md5_uniform, sigmoid
from tickwise.functions.vectors import all_finite, dot, doubles, elements, mix, vector
from tickwise.operators.lookup import join_lookup
from tickwise.operators.ordered import ordered_scan

# Focal loss parameters of the released protocol.
FOCAL_ALPHA, FOCAL_GAMMA = 0.25, 2.0


def score_bags(
    df: DataFrame, column: str, scorer_factory: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "p",
) -> DataFrame:
    """Add a score per row with a user scorer over Arrow batches.

    The factory runs once per task; the scorer maps a ``(rows, width)`` matrix to one
    probability per row. Other columns pass through.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for batch in batches:
            if len(batch):
                batch[out] = scorer(np.stack(batch[column].to_numpy()).astype(float))
                yield batch

    return df.mapInPandas(run, schema)


def linear_scorer(weights: Sequence[float], bias: float) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Factory of a logistic scorer with fixed weights."""
    w = np.asarray(weights, float)
    return lambda: lambda m: 1.0 / (1.0 + np.exp(-(m @ w + bias)))


def bag_features(windows: DataFrame, keys: Sequence[str], order: str, column: str, width: int) -> DataFrame:
    """Fixed-size bag features: mean, population deviation, maximum and last value per channel.

    Plain aggregates with partial results before the shuffle; a long bag needs no special care.
    """
    at = elements(F.col(column), width)
    return windows.groupBy(*keys).agg(
        F.array(
            *[F.avg(a) for a in at],
            *[F.stddev_pop(a) for a in at],
            *[F.max(a) for a in at],
            *[F.max_by(a, F.col(order)) for a in at],
        ).alias("features")
    )


@dataclass(frozen=True)
class BagModel:
    """A fitted logistic classifier on the original scale of the features."""

    weights: tuple[float, ...]
    bias: float
    steps: int
    loss: float


def _column_sums(
    rows: DataFrame, partial: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """Sums over all (v, y, w) rows of what ``partial`` gives for a batch, added up within every task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = partial(np.stack(batch["v"].to_numpy()), batch["y"].to_numpy(), batch["w"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "s": total})

    sums = rows.mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in sums])


def train_bag_classifier(
    bags: DataFrame, features: str, label: str, weight: str | None = None, l2: float = 1e-4, iterations: int = 50
) -> BagModel:
    """Bag-level logistic classifier with class weights and L2, fitted by Newton steps.

    Minimises the weighted mean cross-entropy plus ``l2 / 2`` times the squared weights of the
    standardised features; the bias is free of it. That optimum is unique, so it does not depend on
    partitions or on the solver. One pass per step adds up loss, gradient and curvature within the
    tasks; the driver sees ``width * width`` sums and solves for the step. A step that does not lower
    the loss is halved. At most ``iterations`` passes; bags whose features, label or weight are null
    or not finite take no part. With one class only there is no optimum: the bias gives the smoothed
    rate of that class and the weights are 0.
    """
    v, y = doubles(F.col(features)), F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = bags.select(v.alias("v"), y.alias("y"), w.alias("w")).where(
        F.col("v").isNotNull() & all_finite(F.col("v")) & all_finite(F.array("y", "w")) & (F.col("w") > 0))
    moments = _column_sums(rows, lambda m, t, u: np.concatenate([[u.sum(), u @ t, len(u)], u @ m]))
    if not len(moments):
        raise ValueError("no complete bag to fit on")
    total, positive, count, mean = moments[0], moments[1], moments[2], moments[3:] / moments[0]
    width = len(mean)
    if positive <= 0 or positive >= total:
        rate = (positive / total * count + 0.5) / (count + 1)
        return BagModel((0.0,) * width, float(np.log(rate / (1 - rate))), 0, float("nan"))
    spread = np.sqrt(_column_sums(rows, lambda m, t, u: u @ (m - mean) ** 2) / total)
    spread[spread < 1e-6] = 1.0
    ridge = np.full(width + 1, l2)
    ridge[width] = 0.0

    def measure(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def partial(m: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
            x = np.column_stack([(m - mean) / spread, np.ones(len(m))])
            logit = x @ beta
            p = np.exp(-np.logaddexp(0.0, -logit))
            loss = u @ (np.logaddexp(0.0, logit) - t * logit)
            curve = (x * (u * p * (1 - p))[:, None]).T @ x
            return np.concatenate([[loss], x.T @ (u * (p - t)), curve.ravel()])

        sums = _column_sums(rows, partial) / total
        slope, curve = sums[1 : width + 2], sums[width + 2 :].reshape(width + 1, width + 1)
        return float(sums[0] + ridge @ beta**2 / 2), slope + ridge * beta, curve + np.diag(ridge)

    beta = np.zeros(width + 1)
    beta[width] = np.log(positive / (total - positive))
    loss, slope, curve = measure(beta)
    step = np.linalg.lstsq(curve, slope, rcond=None)[0]
    steps = 1
    # Close to the optimum the loss changes by less than its own rounding, so it decides on large steps only.
    while steps < iterations and np.abs(step).max() > 1e-11:
        steps += 1
        tried = measure(beta - step)
        if tried[0] > loss + 1e-12 * max(1.0, abs(loss)):
            step = step / 2
            continue
        beta = beta - step
        loss, slope, curve = tried
        step = np.linalg.lstsq(curve, slope, rcond=None)[0]
    weights = beta[:width] / spread
    return BagModel(tuple(float(x) for x in weights), float(beta[width] - weights @ mean), steps, loss)


def predict_bags(model: BagModel, bags: DataFrame, features: str, out: str = "p") -> DataFrame:
    """Probability of failure per bag from a fitted classifier; null where a feature is missing."""
    return bags.withColumn(out, sigmoid(dot(F.col(features), vector(model.weights)) + F.lit(model.bias)))


def bce_with_logits(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy from a logit in the form that cannot overflow."""
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    weight = F.lit(1.0) + (w - 1.0) * y
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (F.lit(1.0) - y) * x + weight * soft


def focal_with_logits(
    x: Column, y: Column, pos_weight: Column | float = 1.0, smoothing: float = 0.0,
    alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA,
) -> Column:
    """Focal loss from a logit, targets smoothed first."""
    t = label_smooth(y, smoothing) if smoothing > 0 else y
    p = sigmoid(x)
    p_t = p * t + (F.lit(1.0) - p) * (F.lit(1.0) - t)
    return F.lit(alpha) * F.pow(F.lit(1.0) - p_t, F.lit(gamma)) * bce_with_logits(x, t, pos_weight)


def loss_metrics(
    df: DataFrame, logit: str, y: str, group: Sequence[str] = (), pos_weight: float = 1.0, smoothing: float = 0.0
) -> DataFrame:
    """Mean cross-entropy and mean focal loss."""
    x, t = F.col(logit), F.col(y).cast("double")
    return df.groupBy(*group).agg(
        F.avg(bce_with_logits(x, t, pos_weight)).alias("bce"),
        F.avg(focal_with_logits(x, t, pos_weight, smoothing)).alias("focal"),
    )


def jitter(df: DataFrame, column: str, std: float, seed: int = 42) -> DataFrame:
    """Add Gaussian noise to every element of a vector column; no noise for ``std <= 0``.

    The draws come from md5 uniforms of (row, element), not from a partition-wise generator,
    so a retried task adds the same noise. ``df`` needs a unique ``row_id``.
    """
    if std <= 0:
        return df
    key = F.col("row_id").cast("string")

    def noise(x: Column, i: Column) -> Column:
        at = F.concat(key, F.lit(":"), i.cast("string"))
        u = md5_uniform(md5_key(seed, F.concat(F.lit("u"), at)))
        v = md5_uniform(md5_key(seed, F.concat(F.lit("v"), at)))
        normal = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2.0 * np.pi) * v)
        return x + F.lit(std) * normal

    return df.withColumn(column, F.transform(doubles(F.col(column)), noise))


def mixup(
    df: DataFrame, row: str, batch: str, column: str, label: str, lam: DataFrame, seed: int = 42
) -> DataFrame:
    """Blend every row with a partner of its batch: ``lam * own + (1 - lam) * partner``.

    Rows of a batch are put into one md5 order and into a second one; the i-th of the first
    meets the i-th of the second, an equi-join on (batch, position). ``lam`` has one row
    (batch, lam) per batch.
    """
    keyed = df.withColumn("_a", md5_key(seed, F.col(row))).withColumn("_b", md5_key(seed + 1, F.col(row)))
    own = ordered_scan(keyed, [batch], ["_a", row], index="_pos").select(*df.columns, "_pos")
    partner = ordered_scan(keyed, [batch], ["_b", row], index="_pos").select(
        batch, "_pos", F.col(column).alias("_v"), F.col(label).alias("_y"), F.col(row).alias("partner")
    )
    return (
        join_lookup(own.join(partner, [batch, "_pos"]), lam.select(batch, "lam"), batch, "inner")
        .select(
            row,
            batch,
            "partner",
            mix(F.col(column), F.col("_v"), F.col("lam")).alias(column),
            (F.col("lam") * F.col(label) + (F.lit(1.0) - F.col("lam")) * F.col("_y")).alias(label),
        )
    )


def beta_lambdas(batches: DataFrame, batch: str, alpha: float, seed: int = 42) -> DataFrame:
    """One Beta(alpha, alpha) draw per batch, reproducible from (seed, batch)."""

    @F.pandas_udf("double")
    def draw(b: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(x)]).beta(alpha, alpha) for x in b], dtype=float)

    return batches.select(batch).distinct().withColumn("lam", draw(F.col(batch).cast("long")))


def encode_payloads(
    df: DataFrame, payload: str, encoder_factory: Callable[[], Callable[[list[bytes]], np.ndarray]], out: str = "cnn",
    error: str | None = None,
) -> DataFrame:
    """Encode a binary column into descriptor vectors with a user encoder loaded once per task.

    A missing payload reaches the encoder as empty bytes. Only the columns of ``df`` and the
    descriptor come back; the payload itself is dropped. With ``error`` a payload that the encoder
    rejects does not end the job: a batch that raises is encoded payload by payload, and those that
    raise again have no descriptor and the reason in that column, which is null for all others.
    """
    kept = [f for f in df.schema.fields if f.name != payload]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])
    if error is not None:
        schema = schema.add(error, T.StringType())

    def encoded(encode: Callable[[list[bytes]], np.ndarray], raw: list[bytes]) -> list[np.ndarray]:
        vectors = list(np.asarray(encode(raw), float))
        if len(vectors) != len(raw):
            raise ValueError(f"encoder returned {len(vectors)} vectors for {len(raw)} payloads")
        return vectors

    def guarded(encode: Callable[[list[bytes]], np.ndarray], raw: list[bytes]) -> tuple[list, list]:
        try:
            return encoded(encode, raw), [None] * len(raw)
        except Exception as reason:
            if len(raw) == 1:
                return [None], [f"{type(reason).__name__}: {reason}"]
        single = [guarded(encode, [b]) for b in raw]
        return [v for (v,), _ in single], [r for _, (r,) in single]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for batch in batches:
            if len(batch):
                raw = [b"" if b is None else bytes(b) for b in batch[payload]]
                done = batch.drop(columns=[payload])
                if error is None:
                    done[out] = encoded(encode, raw)
                else:
                    vectors, reasons = guarded(encode, raw)
                    done[out] = pd.Series(vectors, index=done.index, dtype=object)
                    done[error] = pd.Series(reasons, index=done.index, dtype=object)
                yield done

    return df.mapInPandas(run, schema)


def byte_statistics() -> Callable[[list[bytes]], np.ndarray]:
    """A deterministic stand-in encoder: length, and counts of ``<``, blanks and line ends."""

    def encode(raw: list[bytes]) -> np.ndarray:
        return np.array([[len(b), b.count(b"<"), b.count(b" "), b.count(b"\n")] for b in raw], float)

    return encode
