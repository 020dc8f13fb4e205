"""Published numbers that can be recomputed: metrics from confusion counts, split sizes."""

import math

import pytest
from pyspark.sql import functions as F

from tickwise.operators import metrics as me
from tickwise.operators import splits as sp

# (dataset, seed): tn, fp, fn, tp, accuracy, F1 as published.
CONFUSIONS = {
    ("overall", 7): (311, 291, 28, 205, 0.6180, 0.5624),
    ("overall", 42): (322, 280, 32, 197, 0.6245, 0.5581),
    ("overall", 123): (312, 290, 19, 215, 0.6304, 0.5819),
    ("droid", 7): (297, 19, 15, 52, 0.9112, 0.7536),
    ("droid", 42): (310, 6, 16, 47, 0.9420, 0.8103),
    ("droid", 123): (307, 9, 9, 58, 0.9530, 0.8657),
    ("fractal", 7): (26, 260, 16, 150, 0.3894, 0.5208),
    ("fractal", 42): (0, 286, 0, 166, 0.3673, 0.5372),
    ("fractal", 123): (13, 273, 7, 160, 0.3819, 0.5333),
}


def test_accuracy_and_f1_of_published_confusions(spark):
    rows = []
    for (ds, seed), (tn, fp, fn, tp, _, _) in CONFUSIONS.items():
        for p, y, n in ((0.1, 0, tn), (0.9, 0, fp), (0.1, 1, fn), (0.9, 1, tp)):
            rows += [(ds, seed, p, y)] * n
    df = spark.createDataFrame(rows, "ds string, seed int, p double, y int")
    acc = {(r["ds"], r["seed"]): r["accuracy"] for r in me.accuracy(df, ["ds", "seed"], "p", "y", 0.5).collect()}
    f1 = {(r["ds"], r["seed"]): r["f1"] for r in me.f1_score(df, ["ds", "seed"], "p", "y", 0.5).collect()}
    for key, (*_, a, f) in CONFUSIONS.items():
        assert math.isclose(acc[key], a, abs_tol=5e-5) and math.isclose(f1[key], f, abs_tol=5e-5)


def test_summary_over_seeds_uses_the_population_deviation(spark):
    runs = [("droid", 0.6507), ("droid", 0.7307), ("droid", 0.7492)]
    df = spark.createDataFrame(runs, "ds string, sep double")
    row = me.multi_seed_summary(df, ["ds"], ["sep"]).first()
    assert round(row["sep_mean"], 2) == 0.71 and round(row["sep_std"], 2) == 0.04


@pytest.mark.parametrize(
    "n_s,n_f,t_max,train,held_out",
    [(1950, 1143, 3027, (1377, 742), (286, 168)), (3581, 759, 2551, (1161, 625), (316, 67))],
)
def test_proportional_sizes(spark, n_s, n_f, t_max, train, held_out):
    pools = spark.range(n_s + n_f).select(
        F.lit("d").alias("ds"), F.col("id").alias("name"), F.when(F.col("id") < n_f, 1).otherwise(0).alias("y"))
    r = sp.proportional_sizes(pools, "ds", "y").first()
    assert (r["t_max"], (r["tr_s"], r["tr_f"])) == (t_max, train)
    assert (r["va_s"], r["va_f"]) == held_out and (r["te_s"], r["te_f"]) == held_out
    out = sp.split_pools_proportional(pools, "ds", "name", "y")
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"train": sum(train), "val": sum(held_out), "test": sum(held_out)}
