"""Decontamination in natural text against brute force, at several sizes of the benchmark."""

import random

import pytest
from pyspark.sql import functions as F

from tickwise.llm import decontaminate

SOURCE = "/root/testdata/sf0.01/documents.parquet"


def _taken(docs, n, seed):
    """``n`` items of 5 to 29 words out of the documents."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        w = rng.choice(docs)[1].split()
        size = rng.randint(5, 29)
        if len(w) > size:
            at = rng.randrange(len(w) - size)
            out.append((len(out), " ".join(w[at : at + size])))
    return out


def _exact(docs, items):
    """Every (document, item) where the item's words stand in a row."""
    heads, short = {}, {}
    for i, t in items:
        w = decontaminate._folded(t)
        if w:
            heads.setdefault(tuple(w[:4]), []).append((i, w)) if len(w) >= 4 else short.setdefault(i, w)
    assert not short
    found = set()
    for d, t in docs:
        w = decontaminate._folded(t)
        for at in range(len(w)):
            found |= {(d, i) for i, own in heads.get(tuple(w[at : at + 4]), ()) if w[at : at + len(own)] == own}
    return found


@pytest.mark.parametrize("n", [200, 2_000])
def test_every_exact_copy_in_natural_text(spark, n):
    table = spark.read.parquet(SOURCE).select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").limit(1_500)
    docs = [tuple(r) for r in table.collect()]
    items = [x for x in _taken(docs, n, n) if len(decontaminate._folded(x[1])) >= 4]
    want = _exact(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.cosine for r in found.collect()}
    low = sum(got.get(k, 0) < decontaminate.COSINE for k in want)
    print(f"RECALL {n} items: {len(want)} exact copies, {len(want & set(got))} found, {low} of them below the cosine bar")
    assert len(want) >= 0.9 * n and want <= set(got)
