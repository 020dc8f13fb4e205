"""Joins against tables that are usually tiny, with the size checked before a broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.operators.ordered import HotKeys, hot_keys, join_keys

LOOKUP_ROWS = 50_000
SALT = "_salt"


def join_lookup(
    df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join with a table of per-dataset facts (counts, thresholds, scaler rows).

    At most ``max_rows + 1`` rows are fetched. If that is the whole table it is evaluated
    once and broadcast; otherwise this is an ordinary shuffle join, where adaptive execution
    splits skewed partitions.
    """
    on = [on] if isinstance(on, str) else list(on)
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df.join(table, on, how)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, table.schema)), on, how)


def with_group_facts(
    df: DataFrame, on: Sequence[str], facts: Mapping[str, Column], hot: HotKeys | None = None
) -> DataFrame:
    """Add aggregates of each key to its rows.

    Without hot keys this is a window over the key: rows already placed by it are neither
    shuffled again nor computed twice. With hot keys the aggregates are joined back, salted.
    Null is a key like any other in both cases.
    """
    on = list(on)
    if hot is None:
        hot = hot_keys(df, on)
    if not hot:
        whole = Window.partitionBy(*on)
        return df.withColumns({o: e.over(whole) for o, e in facts.items()})
    table = df.groupBy(*on).agg(*[e.alias(o) for o, e in facts.items()])
    return join_facts(df, table, on, "inner", hot)


def join_facts(
    df: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner", hot: HotKeys | None = None
) -> DataFrame:
    """Join rows with at most one fact row per key, where a key may hold a large part of ``df``.

    Rows of hot keys (``hot``, or found by a counting pass) get a salt from a hash of their
    content and their facts are repeated once per salt; all other keys keep salt 0. Adaptive
    skew handling does not do this where a later operator needs the same partitioning. There are
    as many salts as a key needs. Null is a key like any other.
    """
    on = list(on)
    spark = df.sparkSession
    if hot is None:
        hot = hot_keys(df, on)
    if not hot:
        return join_keys(df, facts, on, how)
    salts = spark.createDataFrame(
        [(*key, -(-n // hot.limit)) for key, n in hot.rows],
        T.StructType([*[df.schema[k] for k in on], T.StructField("_salts", T.LongType())]),
    )
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    salted = (
        join_keys(df, salts, on, "left", small=True)
        .withColumn(SALT, F.coalesce(F.pmod(content, F.col("_salts")), F.lit(0).cast("long")))
        .drop("_salts")
    )
    repeated = (
        join_keys(facts, salts, on, "left", small=True)
        .withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return join_keys(salted, repeated, [*on, SALT], how).drop(SALT)
