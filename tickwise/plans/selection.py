"""Choosing sequences to show: failures from the test split, successes from outside all splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.functions.scalars import duration_seconds, episode_id, file_stem
from tickwise.operators.traces import candidate_filter, interleave, topk_scores, two_pass_selection
from tickwise.schema import GRID_HZ, MAX_TICKS, MIN_TICKS, MIN_WINDOWS, SEQ
from tickwise.sources.catalog import heldout_anti, renderable_semi


def select_acts(
    seqs: DataFrame, windows: DataFrame, assigned: DataFrame, pools: DataFrame, index: DataFrame, prefix: str,
    per_label: int = 2, traced: int = 20,
) -> DataFrame:
    """The sequences to show, in playing order (failure, success, failure, success).

    ``seqs`` has (sequence_name, label, ticks, n_windows), ``windows`` (sequence_name, window,
    score), ``assigned`` (sequence_name, split), ``pools`` (sequence_name, label), ``index``
    (file, episode). Failures are taken from the test split, since a split may use up all of
    them; successes are in no split. Failures are ranked by trace, successes by mean score.
    """
    named = seqs.withColumn("file", file_stem(F.col(SEQ), prefix)).withColumn("episode", episode_id(F.col(SEQ)))
    shown = renderable_semi(named, index, ["file", "episode"])
    fit = candidate_filter(shown, pools, [SEQ], "label", "ticks", "n_windows", MIN_TICKS, MAX_TICKS, MIN_WINDOWS)
    tested = assigned.where("split = 'test'").select(SEQ)
    failures = fit.where("label > 0.5").join(tested, SEQ, "left_semi")
    successes = heldout_anti(fit.where("label <= 0.5"), assigned, [SEQ])
    ranked_failures = two_pass_selection(
        windows, [SEQ], "window", "score", failures.select(SEQ, "label"), SEQ, "label", traced
    ).where(F.col("rank") <= per_label).select(SEQ, "score", "rank", F.lit(1).alias("label"))
    means = windows.join(successes.select(SEQ), SEQ, "left_semi").groupBy(SEQ).agg(F.avg("score").alias("score"))
    ranked_successes = topk_scores(means.withColumn("label", F.lit(0)), SEQ, "label", "score", 0, per_label).select(
        SEQ, "score", "rank", "label"
    )
    acts = interleave(ranked_failures.unionByName(ranked_successes), "label")
    return acts.join(seqs.select(SEQ, duration_seconds(F.col("ticks"), GRID_HZ).alias("duration")), SEQ).orderBy("slot")
