"""Connected components of links, by contraction until few links are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.session import staged

#: After so many steps nodes are put in a new order, so that no order can be adverse for long.
STEPS_OF_AN_ORDER = 3
#: So many links, some MB at most, are joined in one task. More are contracted first.
FEW_LINKS = 100_000


def _order(node: Column, step: int) -> Column:
    """Random order of nodes; the first one is that of their hashes."""
    turn = step // STEPS_OF_AN_ORDER
    return F.xxhash64(node, *([F.lit(turn)] if turn else []))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of links (a, b); the root is the smallest node that they reach."""
    up: dict = {}

    def find(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    if up:
        nodes = pa.array(list(up), kind)
        yield pa.RecordBatch.from_arrays([nodes, pa.array([find(x) for x in list(up)], kind)], names=["node", "root"])


def _united_in_a_task(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType.simpleString()
    return staged(links.select("a", "b").where("a <> b").repartition(1).mapInArrow(_united, f"node {kind}, root {kind}"), "roots")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes share a root if they are connected.

    ``rows``, if known, is the number of links. At most ``FEW_LINKS`` are joined in one task at
    once; more go through steps until no more than these are left.

    A step hangs every node on the first of itself and its neighbours, in a random order, and
    replaces both ends of every link by what they hang on; links within one node go. Links and
    nodes shrink by a constant share a step, so few small steps follow the first, and walking
    back through them names the roots. Minima are combined before the shuffle, and every step
    is written to the shared folder, so neither a large component nor a lost executor matters.
    """
    if (links.count() if rows is None else rows) <= FEW_LINKS:
        return _united_in_a_task(links)
    edges = staged(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while edges.count() > FEW_LINKS:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = lambda node: F.struct(_order(F.col(node), len(steps)).alias("h"), F.col(node).alias("x"))  # noqa: B023, E731
        hung = both.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("m"))
        steps.append(staged(hung.select("node", F.least("m", first("node")).getField("x").alias("root")), "hung"))
        a, b = (steps[-1].select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = staged(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    roots = _united_in_a_task(edges)
    if not steps:
        return roots
    while steps:
        roots = _renamed(steps.pop(), roots)
    return staged(roots, "roots")


def _renamed(roots: DataFrame, names: DataFrame) -> DataFrame:
    """``roots`` with each root replaced by its own root in ``names``, where it has one."""
    new = names.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further ``links`` (a, b), which may have nodes of their own."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    names = components(ends, links.count())
    added = names.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return staged(_renamed(roots, names).unionAll(added), "roots")
