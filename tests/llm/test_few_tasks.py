"""Near-dedup starts few tasks for few rows, hands Python small batches, and joins few links at once."""

import random

import pytest

from tickwise.llm import graph, neardup
from tickwise.session import BATCH_CONF

DOCS = "doc_id long, text string"


def _copies(n):
    rng = random.Random(5)
    texts = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(n)]
    near = [[*t[:30], "changed", *t[31:]] for t in texts[: n // 2]]
    return [(i, " ".join(t)) for i, t in enumerate([*texts, *near])]


def _conf(spark, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return before


def test_few_rows_make_few_files_and_small_batches(spark, monkeypatch):
    files, batches, kept = {}, set(), neardup.staged

    def counting(df, label):
        out = kept(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        batches.add(int(spark.conf.get(BATCH_CONF)))
        return out

    monkeypatch.setattr(neardup, "staged", counting)
    rows = _copies(200)
    before = _conf(spark, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", BATCH_CONF: "9000"})
    try:
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), 4).collect()
        assert spark.conf.get(BATCH_CONF) == "9000"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i if i < 200 else i - 200) for i, _ in rows}
    assert max(files.values()) <= spark.sparkContext.defaultParallelism
    assert batches == {neardup.ROWS_AT_ONCE}


@pytest.mark.parametrize("few", [0, 25, 100_000])
def test_components_by_steps_and_in_a_task(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    labels, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: labels.append(label) or kept(df, label))
    links = [(f"p{i}", f"p{i + 1}") for i in range(30)] + [(f"s{i}", "s0") for i in range(20)] + [("x", "x"), ("y", None)]
    random.Random(2).shuffle(links)
    table = lambda rows: spark.createDataFrame(rows, "a string, b string")
    for got in (graph.components(table(links)), graph.merged(graph.components(table(links[:25])), table(links[25:]))):
        root = {r.node: r.root for r in got.collect()}
        assert got.count() == len(root) and set(root) == {f"p{i}" for i in range(31)} | {f"s{i}" for i in range(20)}
        assert {k: len({root[x] for x in root if x[0] == k}) for k in "ps"} == {"p": 1, "s": 1} and len(set(root.values())) == 2
    # Few links take no step at all.
    assert ("hung" in labels) == (few < 100_000)
