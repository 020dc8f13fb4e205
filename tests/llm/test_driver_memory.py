"""What the driver holds of a corpus stage stays small: fitted features, fetched sums, joined tables."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tickwise.llm import decontaminate, neardup, quality


def _packed(rows, each, most):
    rng = np.random.default_rng(3)
    return [np.unique(rng.integers(0, most, each)).astype(np.int32).tobytes() for _ in range(rows)]


def test_classifier_holds_little_beside_its_features():
    packed = _packed(3_000, 400, 200_000)
    size = sum(map(len, packed))
    tracemalloc.start()
    rows = quality._Rows(packed)
    y = (np.arange(len(packed)) % 3 == 0).astype(float)
    quality.fit_view(rows, np.ones(len(packed), bool), y, np.ones(len(packed)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The features are held once, with their rows; beside these come tables and entries of fixed size.
    assert peak < 4 * size + 16_000_000, (peak, size)


def test_features_are_numbered_and_summed_in_order():
    packed = [np.array(x, np.int32).tobytes() for x in ([7, 900_000], [], [3, 7], [900_000])]
    rows = quality._Rows(packed)
    assert rows.names.tolist() == [3, 7, 900_000] and rows.names.dtype == np.int32
    assert rows.flat.tolist() == [1, 2, 0, 1, 2] and rows.row.tolist() == [0, 0, 2, 2, 3]
    assert rows.sums(np.array([1.0, 10.0, 100.0])).tolist() == [110.0, 0.0, 11.0, 100.0]
    none = quality._Rows([])
    assert len(none.names) == len(none.sums(np.empty(0))) == 0


def test_near_dedup_broadcasts_no_table(spark, monkeypatch):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(300)}" for _ in range(40)] for _ in range(60)]
    texts += [[*t[:20], "changed", *t[21:]] for t in texts[:30]] + texts[:5]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    plans, kept = [], neardup.staged

    def planned(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, label)

    monkeypatch.setattr(neardup, "staged", planned)
    out = neardup.without_near_duplicates(docs, 4)
    plans.append(("rows", out._jdf.queryExecution().executedPlan().toString()))
    assert out.count() == 60
    assert {"buckets", "met", "sets", "links", "mixed", "near"} <= {label for label, _ in plans}
    assert [label for label, plan in plans if "BroadcastExchange" in plan] == []


def test_driver_fetches_few_sums_at_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERM_CHUNK", 64)
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 4_096, 30).astype(np.int32).tobytes(), None, 1.0) for _ in range(200)]
    most = []

    def fetching(df, *args):
        at = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("k")).collect()
        most.append(max(r.k for r in at) / sum(r.k for r in at))
        return fetched(df, *args)

    # Sessions have DataFrames of a class of their own.
    frame = spark.createDataFrame(rows, "terms binary, text string, weight double")
    fetched = type(frame).toLocalIterator
    monkeypatch.setattr(type(frame), "toLocalIterator", fetching)
    basis = decontaminate.randomised_basis(frame, np.ones(decontaminate.TERMS, np.float32), np.arange(4_096), 4)
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-3)
    assert len(most) == 2 and max(most) <= 0.25, most
