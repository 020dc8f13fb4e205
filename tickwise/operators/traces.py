"""Score traces over a growing or trailing bag, their metrics, and rankings of sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.ordered import HotKeys, ordered_scan
from tickwise.operators.windows import tail_keep
from tickwise.schema import TAIL_FRACTION, WARM_UP_WINDOWS
from tickwise.session import staged

# Thresholds of the trace metrics and of the ranking rules.
LOW, HIGH = 0.3, 0.6
STRICT = {"start": 0.30, "end": 0.60, "rise": 0.40}
RELAXED = {"start": 0.30, "end": 0.55, "rise": 0.35}
STABLE_MAX = 0.20
# End of fixed values.
TOP_K_IN_ONE_TASK = 100_000


def prefix_bag_trace(
    windows: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, warm_up: int = WARM_UP_WINDOWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Mean score of windows 1..n for every n from the warm-up on: rows (keys, n, p)."""
    run = ordered_scan(windows, keys, order, index="_i", sums={"_s": score}, hot=hot)
    n = F.col("_i") + 1
    return run.where(n >= warm_up).select(*keys, n.alias("n"), (F.col("_s") / n).alias("p"))


def tail_bag_trace(
    windows: DataFrame, keys: Sequence[str], order: Sequence[str], score: str,
    fraction: float | None = TAIL_FRACTION, k: int | None = None, warm_up: int = WARM_UP_WINDOWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Mean score of the last K windows ending at n: rows (keys, n, k, p).

    K is ``max(1, round(fraction * M))`` of the sequence's M windows, or a fixed ``k``. Every
    score enters a running sum at its own position and leaves it K positions later, so the cost
    does not depend on K, and one shuffle and one scan serve the count and the sum.
    """
    run = ordered_scan(windows, keys, order, index="_i", count="_m", hot=hot)
    size = F.lit(k).cast("long") if k is not None else tail_keep(F.col("_m"), fraction)
    n = F.col("_i") + 1
    enters = F.struct(n.alias("n"), F.lit(1).alias("_enters"), F.col(score).cast("double").alias("_d"))
    leaves = F.struct((n + F.col("_k")).alias("n"), F.lit(0).alias("_enters"), (-F.col(score).cast("double")).alias("_d"))
    # At equal positions the one that leaves comes first.
    events = run.withColumn("_k", size).select(
        *keys, "_k", F.explode(F.when(n + F.col("_k") <= F.col("_m"), F.array(enters, leaves)).otherwise(F.array(enters))).alias("_e")
    ).select(*keys, "_k", "_e.*")
    summed = ordered_scan(events, keys, ["n", "_enters"], sums={"_s": "_d"}, hot=hot)
    return summed.where((F.col("_enters") == 1) & (F.col("n") >= warm_up)).select(
        *keys, "n", F.col("_k").alias("k"), (F.col("_s") / F.least(F.col("n"), F.col("_k"))).alias("p")
    )


def trace_metrics(
    trace: DataFrame, keys: Sequence[str], order: str, p: str, hot: HotKeys | None = None
) -> DataFrame:
    """Start, end, rise, extremes, and how gradually the trace crosses the 0.3 to 0.6 band."""
    idx = ordered_scan(trace, keys, [order], index="_i", count="_n", hot=hot)
    i, n, v = F.col("_i"), F.col("_n"), F.col(p)
    third = F.greatest(F.lit(1).cast("long"), F.floor(n / 3))
    base = idx.groupBy(*keys).agg(
        F.avg(F.when(i < third, v)).alias("p_start"),
        F.avg(F.when(i >= n - 2, v)).alias("p_end"),
        F.max(F.when(i == n - 1, v)).alias("final"),
        F.max(v).alias("max_p"),
        F.min(v).alias("min_p"),
        F.min(F.when(v > LOW, i)).alias("_low"),
        F.min(F.when(v >= HIGH, i)).alias("_high"),
        F.count_if((v >= LOW) & (v <= HIGH)).alias("band_count"),
    )
    spread = (
        F.when(F.col("_high") >= F.col("_low"), F.col("_high") - F.col("_low") + 1)
        .when(F.col("_high").isNotNull(), F.lit(1))
        .otherwise(F.lit(0))
    )
    return base.withColumn("rise", F.col("p_end") - F.col("p_start")).withColumn("spread", spread.cast("long")).drop(
        "_low", "_high"
    )


def candidate_filter(
    seqs: DataFrame, pools: DataFrame, keys: Sequence[str], label: str, ticks: str, n_windows: str,
    shortest: int, longest: int, min_windows: int,
) -> DataFrame:
    """Sequences of usable length whose label agrees with the pool they are listed in."""
    fit = seqs.where(F.col(ticks).between(shortest, longest) & (F.col(n_windows) >= min_windows))
    return fit.join(pools.select(*keys, label), [*keys, label], "left_semi")


def _passes(rule: dict[str, float]) -> Column:
    return (
        (F.col("p_start") < rule["start"]) & (F.col("p_end") > rule["end"]) & (F.col("rise") > rule["rise"])
    )


def ranked(
    df: DataFrame, order: Sequence[Column], name: str, out: str = "rank", large: bool = True
) -> DataFrame:
    """1-based rank over a whole table by sort expressions, ties by name.

    ``large=False`` is for tables known to hold a handful of rows, such as a top-k.
    """
    cols = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns({**cols, "_all": F.lit(0)})
    scanned = ordered_scan(keyed, ["_all"], [*cols, name], index="_r", chunk="auto" if large else None)
    return scanned.select(*df.columns, (F.col("_r") + 1).alias(out))


def rank_failures(
    metrics: DataFrame, name: str, strict: dict[str, float] = STRICT, relaxed: dict[str, float] = RELAXED,
    enough: int = 2,
) -> DataFrame:
    """Failures with a late, gradual rise. The relaxed rule applies if too few pass the strict one."""
    hits = metrics.where(_passes(strict)).limit(enough).count()
    rule = strict if hits >= enough else relaxed
    gradual = F.when(F.col("spread") >= 2, 0).otherwise(1)
    return ranked(metrics.where(_passes(rule)), [gradual, -F.col("rise"), -F.col("spread")], name)


def rank_successes(metrics: DataFrame, name: str, highest: float = STABLE_MAX) -> DataFrame:
    """Successes whose trace stays low, lowest peak first."""
    return ranked(metrics.where(F.col("max_p") < highest), [F.col("max_p")], name)


def topk_scores(scores: DataFrame, name: str, label: str, score: str, k_fail: int, k_ok: int) -> DataFrame:
    """The highest-scoring failures and the lowest-scoring successes, with their rank per label.

    Each side is a distributed top-k that keeps k rows per task; the ranks are over k rows.
    """
    fails = scores.where(F.col(label) > 0.5).orderBy(F.desc(score), name).limit(k_fail)
    oks = scores.where(F.col(label) <= 0.5).orderBy(F.asc(score), name).limit(k_ok)
    few = max(k_fail, k_ok) <= TOP_K_IN_ONE_TASK
    return ranked(fails, [-F.col(score)], name, large=not few).unionByName(
        ranked(oks, [F.col(score)], name, large=not few))


def interleave(ranked_rows: DataFrame, label: str, rank: str = "rank") -> DataFrame:
    """Merge two rankings as failure, success, failure, success: adds the place in the sequence."""
    place = (F.col(rank) - 1) * 2 + F.when(F.col(label) > 0.5, 1).otherwise(2)
    return ranked_rows.withColumn("slot", place.cast("long"))


def two_pass_selection(
    windows: DataFrame, keys: Sequence[str], window: str, score: str, labels: DataFrame, name: str, label: str,
    k: int = 20, fraction: float = TAIL_FRACTION, hot: HotKeys | None = None,
) -> DataFrame:
    """Score every sequence once, trace only the best ``k`` failures, and rank those.

    The first pass scores a failure on its last K windows. The k names then reduce the
    windows by a semi-join before the trace is computed.
    """
    keys = list(keys)
    sized = ordered_scan(windows, keys, [window], index="_i", count="_m", hot=hot)
    tail = F.col("_i") >= F.col("_m") - tail_keep(F.col("_m"), fraction)
    first = sized.groupBy(*keys).agg(F.avg(F.when(tail, F.col(score))).alias("score"))
    failures = first.join(labels.where(F.col(label) > 0.5).select(*keys), keys, "left_semi")
    top = failures.orderBy(F.desc("score"), name).limit(k)
    fixed = staged(top, "selected")
    traced = windows.join(fixed.select(*keys), keys, "left_semi")
    shape = trace_metrics(tail_bag_trace(traced, keys, [window], score, fraction, hot=hot), keys, "n", "p", hot)
    gradual = F.when(F.col("spread") >= 2, 0).otherwise(1)
    return ranked(shape.join(fixed, keys), [gradual, -F.col("rise"), -F.col("score")], name, large=k > TOP_K_IN_ONE_TASK)
