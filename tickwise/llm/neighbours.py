"""Approximate nearest neighbours by collision counting with query-centred windows.

Every vector is projected on ``projections`` random lines, and each line's values are kept as
one sorted array. A query opens a window around its own value on every line; a vector that lies
in the window collides there. Windows grow by virtual rehashing: the same arrays serve all
radii, and a larger radius only visits the entries that are new. At radius R a window reaches
R to either side, so a vector at distance R collides with probability 0.683 on each line.
Vectors whose collisions exceed a threshold, two standard deviations below that, are verified
with their exact distance. A search ends when its k-th best verified distance is at most R: a
true neighbour has then been missed with a probability of about 2 %.

Data and queries meet in blocks. Rows are dealt over data blocks, every query visits each data
block in a query block of bounded size, and a task searches one data block for one query block.
Each row is indexed; queries' best k of every block are merged by rank. No block depends on
keys or values, so equal vectors, however many, spread like others.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id. Queries search among vectors of their own length. Rows that share a query's id
are the query's own; of several query rows with one id the smallest vector is searched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
HIT = 0.6827
FIRST_RADIUS = 0.2
GROWTH = 1.25
BLOCK_ROWS = 16_384
LEAST_BLOCKS = 32
QUERY_ROWS = 1_024


def _lines(dim: int, projections: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, projections])).normal(size=(projections, dim))


def search_block(
    data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, projections: int = PROJECTIONS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, data number, distance) of each query's best ``k`` rows of one block."""
    lines = _lines(data.shape[1], projections)
    places = lines @ data.T
    order = np.argsort(places, axis=1, kind="stable")
    places = np.take_along_axis(places, order, axis=1)
    at = queries @ lines.T
    need = projections * HIT - 2 * math.sqrt(projections * HIT * (1 - HIT))
    n = len(data)
    spread = float(np.sqrt(np.mean((data - data.mean(axis=0)) ** 2) * data.shape[1])) or 1.0
    left = np.stack([np.searchsorted(places[j], at[:, j]) for j in range(projections)], axis=1)
    right = left.copy()
    counts = np.zeros((len(queries), n), np.int16)
    best = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
    seen = np.zeros((len(queries), n), bool)
    seen[query_ids[:, None] == ids[None, :]] = True
    active = np.flatnonzero(~seen.all(axis=1))
    radius = FIRST_RADIUS * spread
    while len(active):
        lo = np.stack([np.searchsorted(places[j], at[active, j] - radius, "left") for j in range(projections)], axis=1)
        hi = np.stack([np.searchsorted(places[j], at[active, j] + radius, "right") for j in range(projections)], axis=1)
        going = []
        for row, q in enumerate(active):
            new = [order[j, a:b] for j, (a, b) in enumerate(zip(lo[row], left[q], strict=True)) if a < b]
            new += [order[j, a:b] for j, (a, b) in enumerate(zip(right[q], hi[row], strict=True)) if a < b]
            if new:
                counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            left[q], right[q] = np.minimum(lo[row], left[q]), np.maximum(hi[row], right[q])
            found = np.flatnonzero((counts[q] >= need) & ~seen[q])
            if len(found):
                seen[q, found] = True
                dist = np.sqrt(((data[found] - queries[q]) ** 2).sum(axis=1))
                rows, dist = np.r_[best[q][0], found], np.r_[best[q][1], dist]
                top = np.lexsort((ids[rows], dist))[:k]
                best[q] = rows[top], dist[top]
            done = len(best[q][0]) == k and best[q][1][-1] <= radius
            if not done and not seen[q].all():
                going.append(q)
        active = np.array(going, dtype=np.int64)
        radius *= GROWTH
    sizes = [len(r) for r, _ in best]
    return (
        np.repeat(np.arange(len(queries)), sizes), np.concatenate([r for r, _ in best] or [np.empty(0, np.int64)]),
        np.concatenate([d for _, d in best] or [np.empty(0)]),
    )


def _search(k: int, projections: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        ids, query = t.column("vec_id").to_numpy(), t.column("query").to_numpy()
        dim = t.column("dim")[0].as_py()
        vectors = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        data, queries = np.flatnonzero(~query), np.flatnonzero(query)
        q, r, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(data) and len(queries):
            q, r, dist = search_block(vectors[data], ids[data], vectors[queries], ids[queries], k, projections)
        return pa.table({"query_id": ids[queries][q], "vec_id": ids[data][r], "score": dist})

    return run


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows, ties to the smaller id."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).first()
    data_blocks = max(least_blocks, -(-size.n // block_rows))
    query_blocks = max(1, -(-size.q // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(n)).cast("int")
    asked = rows.where("query").groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"))
    data = rows.select("vec_id", "vector", "dim", F.lit(False).alias("query"), spread(data_blocks, 1).alias("db"), every(query_blocks).alias("qb"))
    asked = asked.select("vec_id", "vector", "dim", F.lit(True).alias("query"), every(data_blocks).alias("db"), spread(query_blocks, 2).alias("qb"))
    found = data.unionByName(asked).groupBy("dim", "db", "qb").applyInArrow(_search(k, projections), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
