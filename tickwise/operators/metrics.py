"""Binary evaluation per dataset and overall, exact and free of single-task sorts.

Scores are first reduced to distinct values per group with a partial aggregate; the running
counts over those come from an ordered scan, which splits a group with very many values.
Positive means failure (label 1), a decision is positive from the threshold on (``>=``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.lookup import join_lookup
from tickwise.operators.ordered import ordered_scan
from tickwise.session import staged

OVERALL = "overall"
DEFAULT_THRESHOLD = 0.5


def with_overall(scores: DataFrame, dataset: str) -> DataFrame:
    """Every row once under its dataset and once under ``overall``."""
    both = F.explode(F.array(F.col(dataset).cast("string"), F.lit(OVERALL)))
    return scores.select(*[c for c in scores.columns if c != dataset], both.alias(dataset))


def score_steps(scores: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """Per group and distinct score: confusion counts when that score is the threshold."""
    group = list(group)
    distinct = scores.groupBy(*group, p).agg(
        F.count_if(F.col(y) > 0.5).alias("_pos"), F.count_if(F.col(y) <= 0.5).alias("_neg")
    )
    run = ordered_scan(
        distinct, group, [p], sums={"_cp": "_pos", "_cn": "_neg"}, totals={"n_pos": "_pos", "n_neg": "_neg"}
    )
    below_pos, below_neg = F.col("_cp") - F.col("_pos"), F.col("_cn") - F.col("_neg")
    return run.select(
        *group,
        F.col(p).alias("threshold"),
        (F.col("n_pos") - below_pos).alias("tp"),
        (F.col("n_neg") - below_neg).alias("fp"),
        below_pos.alias("fn"),
        below_neg.alias("tn"),
        F.col("_pos").alias("pos_here"),
        F.col("_neg").alias("neg_here"),
        "n_pos",
        "n_neg",
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """``2tp / (2tp + fp + fn)``, 0 when undefined."""
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def threshold_f1(scores: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """Threshold of the best F1 over the observed scores, the lowest of equals; 0.5 for one class."""
    return _best_threshold(score_steps(scores, group, p, y), group)


def _best_threshold(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    best = steps.groupBy(*group).agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("neg"))).alias("_b"),
        F.first("n_pos").alias("_p"),
        F.first("n_neg").alias("_n"),
    )
    single = (F.col("_p") == 0) | (F.col("_n") == 0)
    return best.select(
        *group, F.when(single, F.lit(DEFAULT_THRESHOLD)).otherwise(-F.col("_b.neg")).alias("threshold")
    )


def auc(scores: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null for a single class."""
    return score_steps(scores, group, p, y).groupBy(*group).agg(_area().alias("auc"))


def _area() -> Column:
    """Area under the curve from the steps of a group."""
    area = F.sum(F.col("pos_here") * (F.col("tn") + F.col("neg_here") / 2.0))
    pairs = F.max("n_pos") * F.max("n_neg")
    return F.when(pairs > 0, area / pairs)


def roc_curve(scores: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """False and true positive rate at every distinct score (no point is dropped)."""
    steps = score_steps(scores, group, p, y)
    return steps.select(
        *group,
        "threshold",
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def _counts(p: Column, y: Column, thr: Column) -> list[Column]:
    hit, pos = p >= thr, y > 0.5
    return [
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"),
        F.count_if(hit & pos).alias("tp"),
    ]


def confusion(scores: DataFrame, group: Sequence[str], p: str, y: str, threshold: Column | float) -> DataFrame:
    """The four counts at a threshold, which may be a column."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scores.groupBy(*group).agg(*_counts(F.col(p), F.col(y), thr))


def accuracy_of(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Share of right decisions, 0 without any rows."""
    return F.coalesce(F.try_divide((tn + tp).cast("double"), tn + fp + fn + tp), F.lit(0.0))


def _cells() -> tuple[Column, Column, Column, Column]:
    return F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")


def accuracy(scores: DataFrame, group: Sequence[str], p: str, y: str, threshold: Column | float) -> DataFrame:
    """Accuracy per group at a threshold."""
    return confusion(scores, group, p, y, threshold).select(*group, accuracy_of(*_cells()).alias("accuracy"))


def f1_score(scores: DataFrame, group: Sequence[str], p: str, y: str, threshold: Column | float) -> DataFrame:
    """F1 of the failure class per group at a threshold."""
    tn, fp, fn, tp = _cells()
    return confusion(scores, group, p, y, threshold).select(*group, f1_of(tp, fp, fn).alias("f1"))


def class_report(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy, macro and weighted means."""
    tn, fp, fn, tp = _cells()

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    n0, n1, n = tn + fp, fn + tp, tn + fp + fn + tp
    p0, r0, f0 = ratio(tn, tn + fn), ratio(tn, n0), f1_of(tn, fn, fp)
    p1, r1, f1 = ratio(tp, tp + fp), ratio(tp, n1), f1_of(tp, fp, fn)
    acc = accuracy_of(tn, fp, fn, tp)

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * n0 + b * n1, n)

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            support.cast("long").alias("support"),
        )

    lines = F.array(
        line("success", p0, r0, f0, n0),
        line("failure", p1, r1, f1, n1),
        line("accuracy", acc, acc, acc, n),
        line("macro avg", (p0 + p1) / 2.0, (r0 + r1) / 2.0, (f0 + f1) / 2.0, n),
        line("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
    )
    return cells.select(*group, F.inline(lines))


def class_separation(scores: DataFrame, group: Sequence[str], p: str, y: str) -> DataFrame:
    """Mean score on failures minus mean score on successes, an empty class counting 0."""
    on_pos = F.coalesce(F.avg(F.when(F.col(y) > 0.5, F.col(p))), F.lit(0.0))
    on_neg = F.coalesce(F.avg(F.when(F.col(y) <= 0.5, F.col(p))), F.lit(0.0))
    return scores.groupBy(*group).agg(
        on_pos.alias("mean_prob_on_pos"), on_neg.alias("mean_prob_on_neg"), (on_pos - on_neg).alias("class_separation")
    )


def metrics_per_dataset(test: DataFrame, val: DataFrame, dataset: str, p: str, y: str) -> DataFrame:
    """All test metrics per dataset and overall.

    Each dataset is judged at the threshold tuned on its own validation scores, or at the
    global one where it has none; the overall row at the global one. F1 and accuracy at the
    global threshold come along. Both sets of scores are read once and reduced to distinct scores;
    thresholds, counts, areas and means all come from those. A row without a score is in no count.
    """
    columns = [F.col(dataset), F.col(p).alias("_p"), F.col(y).alias("_y")]
    both = test.select(*columns, F.lit(True).alias("_test")).unionByName(val.select(*columns, F.lit(False).alias("_test")))
    steps = score_steps(with_overall(both, dataset), [dataset, "_test"], "_p", "_y")
    # Written along, so that the join on it is one on a column and not on a constant.
    steps = staged(steps.withColumn("_all", F.lit(OVERALL)), "score_steps")
    tuned = _best_threshold(steps.where("not _test"), [dataset]).withColumnRenamed("threshold", "_own")
    overall = tuned.where(F.col(dataset) == OVERALL).select(F.col(dataset).alias("_all"), F.col("_own").alias("_global"))
    rows = join_lookup(
        join_lookup(steps.where("_test"), tuned, dataset), overall, "_all")
    general = F.coalesce("_global", F.lit(DEFAULT_THRESHOLD))
    own = F.coalesce("_own", general)
    score, pos, neg = F.col("threshold"), F.col("pos_here"), F.col("neg_here")

    def counts(at: Column, mark: str = "") -> list[Column]:
        cells = {"tn": (score < at, neg), "fp": (score >= at, neg), "fn": (score < at, pos), "tp": (score >= at, pos)}
        return [F.sum(F.when(c, k).otherwise(0)).alias(mark + o) for o, (c, k) in cells.items()]

    mean_of = lambda k: F.coalesce(F.try_divide(F.sum(score * k), F.sum(F.when(score.isNotNull(), k))), F.lit(0.0))
    cells = rows.groupBy(dataset).agg(
        F.max(own).alias("threshold"),
        *counts(own),
        *counts(general, "_g"),
        _area().alias("auc"),
        mean_of(pos).alias("mean_prob_on_pos"),
        mean_of(neg).alias("mean_prob_on_neg"),
    )
    tn, fp, fn, tp = _cells()
    return cells.select(
        dataset,
        "threshold",
        "tn",
        "fp",
        "fn",
        "tp",
        accuracy_of(tn, fp, fn, tp).alias("accuracy"),
        "auc",
        f1_of(tp, fp, fn).alias("f1"),
        f1_of(F.col("_gtp"), F.col("_gfp"), F.col("_gfn")).alias("f1_global"),
        accuracy_of(F.col("_gtn"), F.col("_gfp"), F.col("_gfn"), F.col("_gtp")).alias("accuracy_global"),
        "mean_prob_on_pos",
        "mean_prob_on_neg",
        (F.col("mean_prob_on_pos") - F.col("mean_prob_on_neg")).alias("class_separation"),
    )


def multi_seed_summary(runs: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of metrics over runs."""
    return runs.groupBy(*group).agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    )


def sequence_summary(
    ticks: DataFrame, keys: Sequence[str], label: str, n_features: int, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows, share of failure ticks and number of features per sequence, with any further aggregates."""
    return ticks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(label).cast("double")).alias("pos_ratio"),
        F.lit(n_features).cast("long").alias("n_features"),
        *[e.alias(o) for o, e in (extra or {}).items()],
    )


def ingest_counters(status: DataFrame, dataset: str, state: str, frames: str) -> DataFrame:
    """Sequences per outcome (ok, skip, empty, fail) and frames of the good ones, per dataset."""
    return status.groupBy(dataset).agg(
        *[F.count_if(F.col(state) == s).alias(s) for s in ("ok", "skip", "empty", "fail")],
        F.coalesce(F.sum(F.when(F.col(state) == "ok", F.col(frames))), F.lit(0)).cast("long").alias("frames"),
    )


def window_counts(windows: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """Sequences with at least one window, and windows, per split."""
    per_bag = windows.groupBy(split, *keys).agg(F.count(F.lit(1)).alias("_w"))
    return per_bag.groupBy(split).agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("_w").cast("long").alias("windows")
    )
