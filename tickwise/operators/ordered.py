"""Ordered per-key computation that survives a key holding a large part of the table.

A plain ``Window.partitionBy(key).orderBy(t)`` puts all rows of a key into one task.
``ordered_scan`` gives the same results, but the rows of a key above a row limit are cut
into consecutive chunks by order value. Each chunk is scanned on its own, one summary row
per chunk is carried to the next chunks, and the two are combined. Keys below the limit
take the plain window, so a table without hot keys costs one shuffle.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
HOT_ROWS_CONF = "spark.tickwise.hotKeyRows"
DEFAULT_HOT_ROWS = 2_000_000
# Bounds on what the driver sees: hot keys and cut points, whatever the table size.
MAX_CUTS = 16_384
SAMPLES_PER_CUT = 16


def quoted(name: str) -> Column:
    """A top-level column by its exact name, which may hold dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_keys(
    df: DataFrame, other: DataFrame, keys: Sequence[str], how: str, small: bool = False
) -> DataFrame:
    """Join on equal keys, where null is a key like any other. ``small`` broadcasts ``other``."""
    names = {k: f"_on_{i}" for i, k in enumerate(keys)}
    renamed = other.select(*[quoted(c).alias(names.get(c, c)) for c in other.columns])
    same = [quoted(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(F.broadcast(renamed) if small else renamed, same, how).drop(*names.values())


def order_value(order: Sequence[str]) -> Column:
    """One value that sorts like the order columns; a plain column keeps aggregates hash-based."""
    return quoted(order[0]) if len(order) == 1 else F.struct(*[quoted(o) for o in order])


def hot_row_limit(spark: SparkSession) -> int:
    """Rows one task may hold of a single key before the key is split."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


@dataclass(frozen=True)
class HotKeys:
    """Keys above the row limit with their sizes: at most ``MAX_CUTS`` of them."""

    rows: tuple[tuple[tuple, int], ...]
    limit: int

    def __bool__(self) -> bool:
        return bool(self.rows)


def hot_keys(df: DataFrame, keys: Sequence[str], size: Column | None = None, max_rows: int | None = None) -> HotKeys:
    """Find the keys that hold more rows than one task should.

    One pass that reads the key columns only. Run it on the base table of a chain and hand
    the result to every operator of the chain, so that none of them has to count its own,
    more expensive input. ``size`` is an aggregate bounding the rows per key where an
    operator multiplies rows. Keys beyond ``MAX_CUTS`` hold less than 1/MAX_CUTS of the rows
    each and stay in one task.
    """
    limit = max_rows or hot_row_limit(df.sparkSession)
    found = (
        df.groupBy(*keys)
        .agg((F.count(F.lit(1)) if size is None else size).cast("long").alias("_n"))
        .where(F.col("_n") > limit)
        .orderBy(F.desc("_n"))
        .limit(MAX_CUTS)
        .collect()
    )
    return HotKeys(tuple((tuple(r[k] for k in keys), r["_n"]) for r in found), limit)


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: HotKeys | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Add a ``_chunk`` number that follows ``order`` inside every hot key; -1 for other keys.

    For hot keys only, a bounded sample gives the cut points; they are fixed on the driver,
    so every branch of a plan sees the same chunks. Returns also the hot keys as a small table,
    or the input unchanged and ``None`` when no key is hot. Rows with equal order values always
    share a chunk.
    """
    spark = df.sparkSession
    if hot is None:
        hot = hot_keys(df, keys)
    total = sum(n for _, n in hot.rows)
    target = max(hot.limit, total // MAX_CUTS)
    chunks = {key: (math.ceil(n / target), n) for key, n in hot.rows}
    chunks = {k: v for k, v in chunks.items() if v[0] > 1}
    if not chunks:
        return df, None

    key_fields = [df.schema[k] for k in keys]
    order_type = T.StructType([df.schema[o] for o in order])
    rates = spark.createDataFrame(
        [(*k, min(1.0, SAMPLES_PER_CUT * n / rows)) for k, (n, rows) in chunks.items()],
        T.StructType([*key_fields, T.StructField("_frac", T.DoubleType())]),
    )
    drawn = (
        df.select(*keys, F.struct(*order).alias("_ord"))
        .transform(lambda d: join_keys(d, rates, keys, "inner", small=True))
        .where(F.rand(11) < F.col("_frac"))
        .select(*keys, "_ord")
        .collect()
    )
    by_key: dict[tuple, list] = defaultdict(list)
    for r in drawn:
        by_key[tuple(r[k] for k in keys)].append(tuple(r["_ord"]))
    cut_rows = []
    for key, values in by_key.items():
        n = chunks[key][0]
        values.sort(key=lambda v: tuple((x is not None, x) for x in v))
        picked = dict.fromkeys(values[len(values) * i // n] for i in range(1, n))
        cut_rows.append((*key, list(picked)))
    cuts = spark.createDataFrame(
        cut_rows, T.StructType([*key_fields, T.StructField("_cuts", T.ArrayType(order_type))])
    )
    longest = max((len(r[-1]) for r in cut_rows), default=0)
    searched = join_keys(df, cuts, keys, "left", small=True).withColumn("_below", F.lit(0))
    value = F.struct(*[quoted(o) for o in order])
    # How many cut points are at or below the value: bisection, one generated step per bit.
    for step in (1 << b for b in reversed(range(longest.bit_length()))):
        passed = F.get(F.col("_cuts"), F.col("_below") + F.lit(step - 1)) <= value
        searched = searched.withColumn(
            "_below", F.col("_below") + F.when(F.coalesce(passed, F.lit(False)), step).otherwise(0)
        )
    # Never null: a "not null" test pushed down here would repeat the whole search.
    chunk = F.when(F.col("_cuts").isNull(), -1).otherwise(F.col("_below"))
    return searched.select(*map(quoted, df.columns), chunk.alias(CHUNK)), cuts.select(*keys)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    index: str | None = None,
    count: str | None = None,
    sums: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    first_valid: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    head: Mapping[str, str] | None = None,
    chunk: str | None = "auto",
    hot: HotKeys | None = None,
    split_keys: DataFrame | None = None,
) -> DataFrame:
    """Add order-dependent columns per key; ``order`` (ascending) must be a total order.

    ``index`` 0-based position; ``count`` rows of the key; ``sums`` running sums;
    ``totals`` sums over the key; ``last`` last non-null so far; ``first_valid`` first
    non-null of the key; ``lag`` / ``lead`` neighbour rows; ``head`` value of the first
    row. Mappings are ``{output column: input column}``. ``chunk`` is ``"auto"`` (split hot
    keys, those in ``hot`` if given), ``None`` (groups known to be small) or the name of a
    chunk column in ``df``, with the ``split_keys`` if it comes from ``split_hot``.
    """
    sums, totals, last = dict(sums or {}), dict(totals or {}), dict(last or {})
    first_valid, lag, lead, head = dict(first_valid or {}), dict(lag or {}), dict(lead or {}), dict(head or {})
    keys, order = list(keys), list(order)
    keep = [quoted(c) for c in df.columns]
    has_chunk = chunk in df.columns

    split = chunk is not None
    if chunk == "auto":
        df, split_keys = split_hot(df, keys, order, hot)
        chunk, split = CHUNK, split_keys is not None
    group = [*keys, chunk] if split else keys

    ordered = Window.partitionBy(*group).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_order = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)

    local: dict[str, Column] = {}
    if index:
        local[index] = (F.row_number().over(ordered) - 1).cast("long")
    if count:
        local[count] = F.count(F.lit(1)).over(whole)
    local |= {out: F.sum(c).over(so_far) for out, c in sums.items()}
    local |= {out: F.sum(c).over(whole) for out, c in totals.items()}
    local |= {out: F.last(c, ignorenulls=True).over(so_far) for out, c in last.items()}
    local |= {out: F.first(c, ignorenulls=True).over(in_order) for out, c in first_valid.items()}
    local |= {out: F.first(c).over(so_far) for out, c in head.items()}
    local |= {out: F.lag(c).over(ordered) for out, c in lag.items()}
    local |= {out: F.lead(c).over(ordered) for out, c in lead.items()}
    if not split:
        return df.select(*keep, *[e.alias(out) for out, e in local.items()])

    if lag:
        local["_opens"] = F.lag(F.lit(1)).over(ordered).isNull()
    if lead:
        local["_closes"] = F.lead(F.lit(1)).over(ordered).isNull()
    scanned = df.select(*keep, *([] if has_chunk else [chunk]), *[e.alias(o) for o, e in local.items()])
    chunked = df if split_keys is None else join_keys(df, split_keys, keys, "left_semi", small=True)
    carry = _carry(chunked, keys, order, chunk, sums, totals, last, first_valid, lag, lead, head)
    if split_keys is not None:
        # At most MAX_CUTS chunks plus one per hot key; rows of other keys match nothing.
        joined = join_keys(scanned, carry, group, "left", small=True)
    else:
        # Same grouping as the scan, so this needs no further shuffle of the rows.
        joined = join_keys(scanned, carry, group, "left")
    carried = F.col("_rows").isNotNull()

    def from_carry(o: str) -> Column:
        return F.when(carried, F.col(f"_c_{o}")).otherwise(F.col(o))

    final: dict[str, Column] = {}
    if index:
        final[index] = F.col(index) + F.coalesce(F.col("_before"), F.lit(0))
    if count:
        final[count] = F.coalesce(F.col("_rows"), F.col(count))
    for o in sums:
        final[o] = F.when(F.col(o).isNull(), F.col(f"_c_{o}")).otherwise(
            F.col(o) + F.coalesce(F.col(f"_c_{o}"), F.lit(0))
        )
    final |= {o: from_carry(o) for o in totals}
    final |= {o: F.coalesce(F.col(o), F.col(f"_c_{o}")) for o in last}
    final |= {o: from_carry(o) for o in [*first_valid, *head]}
    final |= {o: F.when(F.col("_opens"), F.col(f"_c_{o}")).otherwise(F.col(o)) for o in lag}
    final |= {o: F.when(F.col("_closes"), F.col(f"_c_{o}")).otherwise(F.col(o)) for o in lead}
    return joined.select(*keep, *[e.alias(out) for out, e in final.items()])


def _carry(df, keys, order, chunk, sums, totals, last, first_valid, lag, lead, head) -> DataFrame:
    """What every chunk needs to know from the other chunks of its key: one row per chunk."""
    group = [*keys, chunk]
    at = order_value(order)
    summary = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{o}") for o, c in {**sums, **totals}.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{o}") for o, c in last.items()],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{o}") for o, c in first_valid.items()],
        *[F.max_by(c, at).alias(f"_t_{o}") for o, c in lag.items()],
        *[F.min_by(c, at).alias(f"_h_{o}") for o, c in {**lead, **head}.items()],
    )
    by_chunk = Window.partitionBy(*keys).orderBy(chunk)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    across = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summary.select(
        *group,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(across).alias("_rows"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_c_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(across).alias(f"_c_{o}") for o in totals],
        *[F.last(f"_l_{o}", ignorenulls=True).over(before).alias(f"_c_{o}") for o in last],
        *[F.first(f"_f_{o}", ignorenulls=True).over(across).alias(f"_c_{o}") for o in first_valid],
        *[F.lag(f"_t_{o}").over(by_chunk).alias(f"_c_{o}") for o in lag],
        *[F.lead(f"_h_{o}").over(by_chunk).alias(f"_c_{o}") for o in lead],
        *[F.first(f"_h_{o}").over(across).alias(f"_c_{o}") for o in head],
    )
