"""Success and failure pools per dataset, each from where its outcome is recorded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.labels import SUCCESS_METADATA, final_reward, metadata_flag
from tickwise.schema import DATASET, SEQ
from tickwise.sources.catalog import scan_topic_value


def _pool(names: DataFrame, dataset_id: str, outcome: str) -> DataFrame:
    return names.select(F.lit(dataset_id).alias(DATASET), F.lit(outcome).alias("outcome"), SEQ)


def pools_from_metadata(catalog: DataFrame, dataset_id: str) -> DataFrame:
    """Outcome is a flag in the sequence metadata; sequences without it are in no pool."""
    flag = metadata_flag(F.col("user_metadata")[SUCCESS_METADATA])
    named = catalog.where(F.col(DATASET) == dataset_id).select(SEQ, flag.alias("_ok")).where("_ok is not null")
    return named.distinct().select(
        F.lit(dataset_id).alias(DATASET), F.when(F.col("_ok"), "success").otherwise("failure").alias("outcome"), SEQ
    )


def pools_from_topic(catalog: DataFrame, samples: DataFrame, dataset_id: str, topic: str, failed: Column) -> DataFrame:
    """Outcome is any sample of a flag topic; a sequence holding both values is in both pools."""
    bad = scan_topic_value(catalog, samples, SEQ, DATASET, dataset_id, "topic", topic, failed)
    good = scan_topic_value(catalog, samples, SEQ, DATASET, dataset_id, "topic", topic, ~failed)
    return _pool(bad, dataset_id, "failure").unionByName(_pool(good, dataset_id, "success"))


def pools_from_terminal(
    catalog: DataFrame, held: DataFrame, dataset_id: str, order: list[str], reward: str, terminal: str | None
) -> DataFrame:
    """Outcome is the reward at the last terminal row, one aggregate over the aligned rows."""
    ends = final_reward(held, SEQ, order, reward, terminal)
    names = catalog.where(F.col(DATASET) == dataset_id).select(SEQ).distinct()
    return ends.join(names, SEQ, "left_semi").select(
        F.lit(dataset_id).alias(DATASET),
        F.when(F.col("final_reward") > 0, "success").otherwise("failure").alias("outcome"),
        SEQ,
    )


def pools_from_cache(names: DataFrame, features: DataFrame, dataset_id: str) -> DataFrame:
    """Outcome is the label of the stored features; names not stored yet are in no pool."""
    labels = features.where(F.col(DATASET) == dataset_id).groupBy(SEQ).agg(F.max("label").alias("_y"))
    return names.select(SEQ).distinct().join(labels, SEQ).select(
        F.lit(dataset_id).alias(DATASET), F.when(F.col("_y") > 0.5, "failure").otherwise("success").alias("outcome"), SEQ
    )


def build_pools(*parts: DataFrame) -> DataFrame:
    """Pools of all datasets in one table."""
    return reduce(DataFrame.unionByName, parts)
