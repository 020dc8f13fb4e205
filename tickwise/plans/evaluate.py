"""Split, window, scale, pool, fit, score and report, from a feature table and pools."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.functions.vectors import doubles, elements, fit_width, route_instruction
from tickwise.operators import metrics as me
from tickwise.operators import scaling as sl
from tickwise.operators import scoring as so
from tickwise.operators import splits as sp
from tickwise.operators import windows as wi
from tickwise.operators.lookup import join_facts
from tickwise.operators.ordered import HotKeys, hot_keys
from tickwise.schema import DATASET, SEQ, TIME, WINDOW_TICKS
from tickwise.session import staged
from tickwise.sources.catalog import dataset_list_union, pool_intersect
from tickwise.sources.tables import run_report

KEYS = [DATASET, SEQ]


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the defaults are those of the released protocol.

    ``cnn_width`` and ``instruction_dim`` switch on the descriptors (``cnn``) and the instruction
    vector (``nl_emb``) of the feature table; 0 leaves them out. A step of the fit brings the square
    of all widths to the driver, so wide descriptors go through ``pca_fit`` first.
    """

    length: int = WINDOW_TICKS
    stride: int = WINDOW_TICKS
    width: int = 16
    cnn_width: int = 0
    instruction_dim: int = 0
    without_instruction: Sequence[str] = ("droid",)
    seed: int = 42
    success_ratio: float = sp.SUCCESS_RATIO
    tail: Mapping[str, float] | None = None
    tail_only_label: int | None = 1
    l2: float = 1e-4


def assign(
    features: DataFrame, pools: DataFrame | None, s: Settings,
    train_on: Sequence[str] | None = None, test_on: Sequence[str] | None = None,
) -> DataFrame:
    """Cached sequences with their split, by one of three modes.

    Datasets to train and to test on that have nothing in common: zero-shot, all of the test datasets
    is test. Otherwise the training datasets (all, if none are named) are split among themselves, by
    pools where there are pools, else stratified on the largest label of a sequence.
    """
    if train_on and test_on and dataset_list_union(train_on, test_on)[1]:
        return sp.split_zeroshot(features.select(*KEYS).distinct(), DATASET, SEQ, train_on, test_on)
    if train_on:
        features = features.where(F.col(DATASET).isin(list(train_on)))
    if pools is None:
        labelled = features.groupBy(*KEYS).agg(F.coalesce(F.max("label"), F.lit(0.0)).alias("seq_label"))
        return sp.split_stratified(labelled, DATASET, SEQ, "seq_label", s.seed)
    labelled = pools.select(*KEYS, F.when(F.col("outcome") == "failure", 1).otherwise(0).alias("pool_label"))
    usable = pool_intersect(features.select(*KEYS), labelled, DATASET, SEQ, "pool_label")
    return sp.split_pools_proportional(usable, DATASET, SEQ, "pool_label", s.seed, s.success_ratio)


def split_ticks(features: DataFrame, assigned: DataFrame, s: Settings, hot: HotKeys | None = None) -> DataFrame:
    """Clean ticks of the assigned sequences with their split; vectors have their full widths.

    Ticks whose kinematic vector is not finite go. Elements of a descriptor that are not finite
    become null, which neither the scaler nor a window's mean counts; a missing descriptor is zero.
    A name listed in both pools may have been drawn twice; it keeps one split here.
    """
    one = assigned.groupBy(*KEYS).agg(F.min("split").alias("split"))
    clean = wi.clean_vectors(join_facts(features, one, KEYS, hot=hot), "kin", s.width)
    cnn = []
    if s.cnn_width:
        fitted = fit_width(F.coalesce(doubles(F.col("cnn")), F.array().cast("array<double>")), s.cnn_width)
        cnn = [F.transform(fitted, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x)).alias("cnn")]
    return clean.select(*KEYS, TIME, "split", "kin", *cnn, "label")


def fit_scalers(ticks: DataFrame, s: Settings, hot: HotKeys | None = None) -> DataFrame:
    """Scalers (stream, channel, mean, std) over every tick of every training window.

    A tick counts as often as complete windows cover it, so overlapping windows are never built.
    """
    covered = wi.coverage(ticks.where("split = 'train'"), KEYS, [TIME], s.length, s.stride, hot=hot).where("n_windows > 0")
    widths = {"kin": s.width} | ({"cnn": s.cnn_width} if s.cnn_width else {})
    return sl.scaler_table([(v, sl.fit_scaler_sumsq(covered, v, "n_windows", w)) for v, w in widths.items()])


def windowed(ticks: DataFrame, s: Settings, hot: HotKeys | None = None) -> DataFrame:
    """Window rows with the split, the label and the mean vector of each input."""
    widths = {"kin": s.width} | ({"cnn": s.cnn_width} if s.cnn_width else {})
    means = {v: [F.avg(x) for x in elements(F.col(v), w)] for v, w in widths.items()}
    rows = wi.sliding_windows(
        ticks, KEYS, [TIME], s.length, s.stride, "label",
        {"split": F.min("split"), **{f"m_{v}": F.array(*m) for v, m in means.items()}}, hot,
    )
    return rows.select(*KEYS, "split", "window", "y", *[F.col(f"m_{v}").alias(v) for v in widths])


def with_instruction(bags: DataFrame, features: DataFrame, s: Settings) -> DataFrame:
    """Append the first instruction vector of a bag's sequence and the flag of its absence.

    Datasets in ``without_instruction`` and sequences that have none get zeros.
    """
    v = fit_width(F.col("nl_emb"), s.instruction_dim)
    known = F.col("nl_emb").isNotNull()
    first = features.groupBy(*KEYS).agg(F.min_by(F.when(known, v), F.when(known, F.col(TIME))).alias("nl"))
    flag = F.col(DATASET).isin(list(s.without_instruction))
    told = wi.bag_attributes(bags, first, KEYS, "nl", s.instruction_dim, flag)
    zeros = F.array_repeat(F.lit(0.0), s.instruction_dim)
    return told.withColumn(
        "features", F.concat("features", route_instruction(F.col("nl"), F.col("use_null"), zeros), F.array(F.col("use_null").cast("double")))
    ).select(*bags.columns)


def train_and_evaluate(
    features: DataFrame, pools: DataFrame | None = None, s: Settings | None = None,
    train_on: Sequence[str] | None = None, test_on: Sequence[str] | None = None, scaler_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit on train, tune thresholds on val, judge on test. Returns (metrics, bag scores).

    Splits as in ``assign``. Windows are written to the shared folder once: the classifier and the
    scores read them, and a lost executor costs no recomputation. Scalers are fitted on ticks
    and written, to ``scaler_path`` if given; scaling a window's mean is the mean of its scaled ticks.
    """
    s = s or Settings()
    hot = hot_keys(features, KEYS)
    assigned = staged(assign(features, pools, s, train_on, test_on), "assigned")
    ticks = split_ticks(features, assigned, s, hot)
    scalers = fit_scalers(ticks, s, hot)
    if scaler_path:
        scalers.write.mode("overwrite").parquet(scaler_path)
        scalers = features.sparkSession.read.schema(scalers.schema).parquet(scaler_path)
    else:
        scalers = staged(scalers, "scalers")
    scaled = staged(windowed(ticks, s, hot), "windows")
    streams = ["kin", *(["cnn"] if s.cnn_width else [])]
    for v in streams:
        scaled = sl.apply_scaler(scaled, scalers.where(F.col("stream") == v), v)
    scaled = scaled.withColumn("v", F.concat(*streams)).drop(*streams)
    kept = wi.bag_tail_filter(
        scaled, KEYS, "window", "y", DATASET, dict(s.tail or {}), s.tail_only_label, hot)
    heads = kept.groupBy(*KEYS).agg(F.min("split").alias("split"), F.max("bag_label").alias("bag_label"))
    bags = so.bag_features(kept, KEYS, "window", "v", s.width + s.cnn_width).join(heads, KEYS)
    if s.instruction_dim:
        bags = with_instruction(bags, join_facts(features, assigned.select(*KEYS).distinct(), KEYS, "left_semi", hot), s)
    bags = staged(bags, "bags")
    train = bags.where("split = 'train'")
    weighted = staged(sp.class_weights(train, "bag_label").select("features", "bag_label", "weight"), "weighted")
    model = so.train_bag_classifier(weighted, "features", "bag_label", "weight", s.l2)
    scores = so.predict_bags(model, bags, "features").select(*KEYS, "split", "p", F.col("bag_label").alias("y"))
    metrics = me.metrics_per_dataset(
        scores.where("split = 'test'"), scores.where("split = 'val'"), DATASET, "p", "y")
    return metrics, scores


def report(windows: DataFrame, metrics: DataFrame, s: Settings, path: str | None = None) -> DataFrame:
    """Window counts per dataset next to the metrics, with the settings; JSON if a path is given."""
    counts = me.window_counts(windows, DATASET, [SEQ])
    config = {k: v for k, v in vars(s).items()}
    return run_report(counts, metrics, [DATASET], config, path)
