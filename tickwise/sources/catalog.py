"""Catalog selection: by dataset, by metadata, by sample value, by topic; pools of sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def scan_dataset(catalog: DataFrame, dataset: str, value, name: str) -> DataFrame:
    """Names of all sequences of a dataset (filter reaches the scan; not de-duplicated)."""
    return catalog.where(F.col(dataset) == value).select(name)


def promoted_name(key: str) -> str:
    """Column that holds a promoted metadata value."""
    return f"meta_{key}"


def promote_metadata(catalog: DataFrame, metadata: str, keys: Sequence[str]) -> DataFrame:
    """Add the values of JSON keys as string columns, for a catalog that is about to be written.

    The JSON is parsed once per row into a variant, whatever the number of keys. A key that is
    missing, or text that is no JSON, is null. Parquet keeps minima and maxima of these columns,
    so scans for a value skip what cannot hold it.
    """
    parsed = catalog.withColumn("_variant", F.try_parse_json(metadata))
    return parsed.withColumns(
        {promoted_name(k): F.try_variant_get("_variant", f"$.{k}", "string") for k in keys}).drop("_variant")


def scan_metadata_eq(catalog: DataFrame, name: str, equals: Mapping[str, str], metadata: str) -> DataFrame:
    """Distinct names whose JSON metadata equals every given value.

    Keys that the catalog has as promoted columns are filtered in the scan; only the others are
    looked up in the JSON text.
    """
    wanted: Column = F.lit(True)
    for key, value in equals.items():
        promoted = promoted_name(key) in catalog.columns
        found = F.col(promoted_name(key)) if promoted else F.get_json_object(F.col(metadata), f"$.{key}")
        wanted = wanted & (found == F.lit(str(value)))
    return catalog.where(wanted).select(name).distinct()


def topic_value_pools(
    catalog: DataFrame, samples: DataFrame, name: str, dataset: str, topic: str, topic_name: str, outcomes: Mapping[str, Column],
    out: str = "outcome",
) -> DataFrame:
    """(dataset, outcome, name) of all datasets and outcomes at once, from one scan of the samples.

    A sequence is in the pool of every outcome that some sample of the topic has; one aggregate
    tests all of them.
    """
    hits = samples.where(F.col(topic) == topic_name).groupBy(name).agg(
        *[F.coalesce(F.bool_or(p), F.lit(False)).alias(o) for o, p in outcomes.items()])
    held = F.array_compact(F.array(*[F.when(F.col(o), F.lit(o)) for o in outcomes]))
    listed = catalog.where(F.col(dataset).isNotNull()).select(dataset, name).distinct()
    return listed.join(hits, name).select(dataset, F.explode(held).alias(out), name)


def scan_topic_value(
    catalog: DataFrame, samples: DataFrame, name: str, dataset: str, dataset_id, topic: str, topic_name: str,
    predicate: Column,
) -> DataFrame:
    """Sequences of a dataset in which some sample of a topic satisfies the predicate.

    Two opposite predicates are independent: a sequence holding both values is in both pools.
    """
    hits = samples.where((F.col(topic) == topic_name) & predicate).select(name).distinct()
    return catalog.where(F.col(dataset) == dataset_id).select(name).distinct().join(hits, name, "left_semi")


def scan_topics_available(samples: DataFrame, name: str, topic: str, wanted: Sequence[str]) -> DataFrame:
    """Requested topics each sequence really has; sequences with none are left out."""
    return samples.where(F.col(topic).isin(list(wanted))).select(name, topic).distinct()


def topics_of(catalog: DataFrame, topics: str, wanted: Sequence[str]) -> DataFrame:
    """The same from a catalog that lists topics per sequence."""
    both = F.array_intersect(F.array(*[F.lit(t) for t in wanted]), F.col(topics))
    return catalog.withColumn("available", both).where(F.size("available") > 0)


def cap_per_dataset(names: DataFrame, dataset: str, name: str, cap: int) -> DataFrame:
    """The first ``cap`` names of every dataset in name order.

    The limit is a rank, so each task keeps ``cap`` rows per dataset before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(dataset).orderBy(name))
    return names.withColumn("_rank", rank).where(F.col("_rank") <= cap).select(*names.columns)


def pool_label_join(
    names: DataFrame, cache: DataFrame, name: str, label: str, cap: int | None = None
) -> DataFrame:
    """Catalog names with their cached label; null where there is none yet.

    A cap is applied in name order before the lookup, so names without a label use it up.
    """
    distinct = names.select(name).distinct()
    if cap:
        distinct = distinct.orderBy(name).limit(cap)
    return distinct.join(cache.select(name, F.col(label).alias("label")), name, "left")


def pool_label_counts(joined: DataFrame) -> DataFrame:
    """Successes, failures and names not in the cache."""
    return joined.agg(
        F.count_if(F.col("label") <= 0.5).alias("success"),
        F.count_if(F.col("label") > 0.5).alias("failure"),
        F.count_if(F.col("label").isNull()).alias("missing"),
    )


def pool_intersect(cached: DataFrame, pools: DataFrame, dataset: str, name: str, label: str) -> DataFrame:
    """Cached names that are in a pool; a dataset with an empty class is dropped.

    A name listed in both pools comes back once per pool.
    """
    kept = cached.select(dataset, name).distinct().join(
        pools.select(dataset, name, label).distinct(), [dataset, name]
    )
    usable = kept.groupBy(dataset).agg(
        F.count_if(F.col(label) > 0.5).alias("_f"), F.count_if(F.col(label) <= 0.5).alias("_s")
    ).where("_f > 0 and _s > 0")
    return kept.join(usable.select(dataset), dataset, "left_semi")


def heldout_anti(cached: DataFrame, splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cached sequences in no split."""
    return cached.join(splits.select(*keys).distinct(), list(keys), "left_anti")


def renderable_semi(seqs: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sequences whose (file, episode) exists in the index."""
    return seqs.join(index.select(*keys).distinct(), list(keys), "left_semi")


def dataset_list_union(train: Sequence[str], test: Sequence[str]) -> tuple[list[str], bool]:
    """Datasets in first-seen order, and whether train and test are disjoint (zero-shot)."""
    return list(dict.fromkeys([*train, *test])), set(train).isdisjoint(test)


def dataset_union(train: DataFrame, test: DataFrame, dataset: str) -> DataFrame:
    """The same for dataset columns of two tables: every id once, with where it occurs."""
    tagged = train.select(dataset, F.lit(1).alias("_tr"), F.lit(0).alias("_te")).unionAll(
        test.select(dataset, F.lit(0), F.lit(1))
    )
    return tagged.groupBy(dataset).agg(F.max("_tr").alias("in_train"), F.max("_te").alias("in_test"))


def pools_distinct_sorted(names: DataFrame, name: str) -> DataFrame:
    """Distinct names in order, by a range-partitioned sort."""
    return names.select(name).distinct().orderBy(name)
