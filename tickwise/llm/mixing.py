"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the budget, and a document's fractional copy number is its
source's target over its source's size. Whole copies are given at once. The remaining fractions
are settled by duels: two documents of a source put their fractions together, one of them wins
or loses as much as the other's words allow, at odds that keep each expectation, and at least
one of the two is then integral. A duel moves words and loses none, so a source's taken words
differ from its target by at most one document.

Duels run in chunks of a source, in parallel. A chunk leaves at most one undecided document;
these residuals are combined by the same duels, ``fan_in`` chunks at a time, in a reduction
tree, until one is left per source, which a last draw settles. A source of any size is dealt
over as many chunks as it needs. Draws come from hashes of the documents, so reruns and retried
tasks agree.

A null text has size 0 and takes its share of copies like any other document (its words add
nothing). Rows that repeat are separate documents. A null source is a source of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.llm.words import mix, whole_groups
from tickwise.session import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
CHUNK_ROWS = 1_000
FAN_IN = 500
WORD = r"[^\x20\x09-\x0D]+"
Batches = Iterator[pa.RecordBatch]


def n_words(text: Column) -> Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MOST_COPIES) -> list[float]:
    """Words to take of each source: the budget by weight, what exceeds ``most`` times a size reshared.

    Exact arithmetic, so the order in which sources reach their limits cannot depend on rounding.
    """
    total = Fraction(budget)
    limits = [Fraction(s) * Fraction(most) for s in sizes]
    out = [Fraction(0)] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        weight = sum(Fraction(weights[i]) for i in free)
        full = {i for i in free if weight and total * Fraction(weights[i]) / weight >= limits[i]}
        if not full:
            for i in free:
                out[i] = total * Fraction(weights[i]) / weight if weight else Fraction(0)
            break
        for i in full:
            out[i] = limits[i]
            total -= limits[i]
        free -= full
    return [float(x) for x in out]


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target, n_docs) per source, sources by code point with null last.

    One row per source reaches the driver, as many as a list of weights has: sources are the
    named inputs of a mix.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    budget = Fraction(str(share)) * sum(r["size"] for r in rows)
    given = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], budget, most)
    schema = T.StructType([
        T.StructField("source", sized.schema["source"].dataType), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("n_docs", T.LongType()),
    ])
    table = [(r.source, r["size"], g, r["n"]) for r, g in zip(rows, given, strict=True)]
    return sized.sparkSession.createDataFrame(table, schema)


def _duels(size: np.ndarray, part: np.ndarray, draw: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """(1 where a copy is won, 0 where not; index of the undecided document or -1).

    ``part`` holds fractions in (0, 1). Mass moves in words: what one document's probability
    loses times its size is what the other's gains.
    """
    won = np.zeros(len(size), np.int64)
    hold, p = -1, 0.0
    for i in range(len(size)):
        q = float(part[i])
        if hold < 0:
            hold, p = i, q
            continue
        s, t, r = float(size[hold]), float(size[i]), float(draw[i])
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if r * (up + down) < down:
            full, rest = up == (1 - p) * s, q * t - up
            if full:
                won[hold] = 1
                q = rest / t
                hold, p = (i, q) if q > 1e-12 else (-1, 0.0)
            else:
                p += up / s
        else:
            empty, rest = down == p * s, q * t + down
            if empty:
                q = rest / t
                if q > 1 - 1e-12:
                    won[i] = 1
                    hold, p = -1, 0.0
                else:
                    hold, p = i, q
            else:
                won[i] = 1
                p -= down / s
        if hold >= 0 and p > 1 - 1e-12:
            won[hold] = 1
            hold, p = -1, 0.0
        elif hold >= 0 and p < 1e-12:
            hold, p = -1, 0.0
    if hold >= 0:
        part[hold] = p
        if last:
            won[hold] = int(draw[hold] < p)
            hold = -1
    return won, hold


def _round(columns: Sequence[str], last: bool) -> Callable[[Batches], Batches]:
    """One level of the tree: settle all documents of each chunk but one."""

    def run(batches: Batches) -> Batches:
        for t in whole_groups(batches, ["_chunk"], 20_000):
            chunk, key = t.column("_chunk").to_numpy(), t.column("_key").to_numpy().view(np.uint64)
            size, part = t.column("_mass").to_numpy(), t.column("_part").to_numpy().copy()
            draw = (mix(key + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)) / float(1 << 53)
            edges = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
            copies, left = t.column("_copies").to_numpy().copy(), np.zeros(len(chunk), bool)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                open_ = lo + np.flatnonzero((part[lo:hi] > 0) & (part[lo:hi] < 1))
                p = part[open_]
                won, hold = _duels(size[open_], p, draw[open_], last)
                part[open_] = p
                copies[open_] += won
                if hold >= 0:
                    left[open_[hold]] = True
            part[~left] = 0.0
            arrays = [t.column(c).combine_chunks() for c in columns]
            yield from pa.Table.from_arrays(
                [*arrays, pa.array(copies), pa.array(part)], names=[*columns, "_copies", "_part"]
            ).combine_chunks().to_batches()

    return run


def mix_sources(
    docs: DataFrame, size: Column, source_col: str = "source", key_cols: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 7,
    chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and copies.

    ``key_cols`` feed the draws. Columns of these four names are replaced. No document gets more than ``most`` copies; a source's copies
    times sizes sum to its target up to one document.
    """
    docs = docs.withColumn("_size", size).drop("size", "source_size", "target", "copies")
    own = [c for c in docs.columns if c != "_size"]
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key_cols])
    sized = docs.withColumnRenamed("_size", "size")
    table = source_targets(sized.select(F.col(f"`{source_col}`").alias("source"), "size"), weights, share, most)
    # As many rows as there are sources, counted above.
    facts = F.broadcast(table.withColumnsRenamed({"source": "_source", "n_docs": "_n"}))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk_rows))
    start = (
        sized.join(facts, F.col(f"`{source_col}`").eqNullSafe(F.col("_source")))
        .withColumns({"_key": key, "_whole": F.floor(ratio), "_mass": F.greatest(F.col("size"), F.lit(1)).cast("double")})
        .withColumns({
            "_group": F.xxhash64("_source", F.col("_source").isNull()),
            "_number": F.pmod(F.col("_key"), chunks), "_copies": F.col("_whole").cast("long"), "_part": ratio - F.col("_whole"),
        })
        .drop("_source", "_n", "_whole")
    )
    largest = max((r.n_docs for r in table.select("n_docs").collect()), default=0)
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(largest / chunk_rows)), fan_in)))
    plain = [c for c in start.columns if c not in ("_copies", "_part", "_chunk")]
    done: list[DataFrame] = []
    for level in range(levels):
        last = level == levels - 1
        number = F.floor(F.col("_number") / fan_in) if level else F.col("_number")
        dealt = (
            start.withColumn("_number", number.cast("long")).withColumn("_chunk", F.xxhash64("_group", "_number"))
            .repartition("_chunk").sortWithinPartitions("_chunk", "_key")
        )
        names = [*plain, "_copies", "_part"]
        schema = T.StructType([f for c in names for f in dealt.schema.fields if f.name == c])
        out = dealt.mapInArrow(_round(plain, last), schema)
        if last:
            done.append(out)
        else:
            out = staged(out, "mixed")
            done.append(out.where("_part = 0"))
            start = out.where("_part > 0")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("copies", F.col("_copies")).select(*own, "size", "source_size", "target", "copies")
