"""Null is a key like any other, whether or not keys are split; scalers agree on odd vectors."""

import pytest
from pyspark.sql import functions as F

from tickwise.operators.align import hold_resample, hold_resample_chunked
from tickwise.operators.lookup import join_facts, with_group_facts
from tickwise.operators.ordered import hot_keys, ordered_scan
from tickwise.operators.scaling import fit_scaler, fit_scaler_sumsq
from tickwise.sources.catalog import cap_per_dataset

ROWS = [(None, 1, 1.0), (None, 2, 2.0), (None, 3, 5.0), ("a", 1, 3.0), ("a", 2, 4.0), ("a", 3, None), ("b", 1, 7.0)]


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(ROWS, "k string, t long, v double")


def test_group_facts_keep_null_keys(keyed):
    facts = {"total": F.sum("v"), "n": F.count(F.lit(1))}
    cold = with_group_facts(keyed, ["k"], facts, hot_keys(keyed, ["k"], max_rows=100))
    hot = with_group_facts(keyed, ["k"], facts, hot_keys(keyed, ["k"], max_rows=1))
    assert _rows(cold) == _rows(hot.select(cold.columns)) and cold.count() == len(ROWS)


def test_joined_facts_reach_null_keys(keyed):
    facts = keyed.groupBy("k").agg(F.max("t").alias("last"))
    for limit in (1, 100):
        out = join_facts(keyed, facts, ["k"], hot=hot_keys(keyed, ["k"], max_rows=limit))
        assert out.count() == len(ROWS) and out.where("last IS NULL").isEmpty()


def test_a_null_key_is_split(keyed):
    scan = dict(index="i", count="n", sums={"s": "v"}, last={"l": "v"}, lag={"p": "v"}, lead={"q": "v"}, head={"h": "v"})
    cold = ordered_scan(keyed, ["k"], ["t"], hot=hot_keys(keyed, ["k"], max_rows=100), **scan)
    hot = ordered_scan(keyed, ["k"], ["t"], hot=hot_keys(keyed, ["k"], max_rows=1), **scan)
    assert _rows(cold) == _rows(hot)


def test_chunked_hold_equals_hold_with_null_keys(spark, keyed):
    samples = keyed.withColumn("topic", F.lit("x"))
    args = (samples, "k", "t", "topic", "v", {"x": "x"}, 1)
    assert _rows(hold_resample(*args)) == _rows(hold_resample_chunked(*args, 2))


@pytest.mark.parametrize("width", [None, 2, 3, 200])
def test_scalers_agree_on_null_short_and_long_vectors(spark, width):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, None],), ([5.0],), ([2.0, 4.0, 8.0, 1.0],), (None,)], "v array<double>")
    a, b = (sorted(f(df, "v", width=width).collect()) for f in (fit_scaler, fit_scaler_sumsq))
    assert len(a) == (4 if width is None else width)
    for x, y in zip(a, b, strict=True):
        assert x.channel == y.channel and x["mean"] == pytest.approx(y["mean"]) and x["std"] == pytest.approx(y["std"])


def test_cap_is_a_rank_limit(keyed):
    out = cap_per_dataset(keyed.select("k", "t"), "k", "t", 2)
    assert out.count() == 5
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
