"""What the physical plans must look like."""

import os

import pytest

import oracle
from pyspark.sql import functions as F

from tickwise.operators import align as al
from tickwise.operators import windows as wi
from tickwise.operators.ordered import HotKeys
from tickwise.queries import QUERIES, load_all
from tickwise.sources import catalog as cat
from tickwise.sources.tables import bucketed_table_read, bucketed_table_write
from tickwise.queries.common import HOUR_US, TOPICS, samples

load_all()
SF = os.path.join(oracle.TESTDATA, "sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return sum("Exchange hashpartitioning" in line for line in plan(df).splitlines())


def test_alignment_and_differences_shuffle_once(spark):
    held = QUERIES["hold_resample"](spark, SF)
    assert shuffles(held) == 1
    hot = al.grid_hot_keys(samples(spark, SF), "sequence_name", "t", HOUR_US)
    rates = al.finite_difference(held, ["sequence_name"], "t", {"r": "click"}, 1e6, hot=hot)
    assert shuffles(rates) == 1


def test_summary_shuffles_once(spark):
    assert shuffles(QUERIES["aligned_summary"](spark, SF)) == 1


def test_windows_shuffle_once(spark):
    assert shuffles(QUERIES["sliding_windows"](spark, SF)) == 1


def scans(df):
    return plan(df).count("FileScan parquet")


@pytest.mark.parametrize("name,most_scans,most_shuffles", [
    ("pool_gated_attention", 2, 2), ("pool_attention", 2, 3), ("pool_mean", 2, 2), ("pool_max", 3, 3), ("tail_bag_trace", 1, 1),
    ("scan_topic_value", 2, 4), ("linear_interp_trace", 2, 3), ("jump_segment", 2, 2),
    ("split_stratified", 2, 1), ("windows_by_split", 2, 2), ("metrics_per_dataset", 1, 1),
])
def test_scans_and_shuffles_stay_few(spark, name, most_scans, most_shuffles):
    df = QUERIES[name](spark, SF)
    assert scans(df) <= most_scans and shuffles(df) <= most_shuffles


def test_gate_is_computed_once_per_result(spark):
    assert plan(QUERIES["pool_gated_attention"](spark, SF)).count("ArrowEvalPython") == 2


def test_promoted_metadata_reaches_the_scan(spark, tmp_path):
    rows = [("a", '{"robot": "arm", "n": 5}'), ("b", '{"robot": "leg"}'), ("c", "no json"), ("d", None), ("a", '{"robot": "arm"}')]
    path = str(tmp_path / "catalog")
    cat.promote_metadata(spark.createDataFrame(rows, "name string, meta string"), "meta", ["robot", "n"]).write.parquet(path)
    found = cat.scan_metadata_eq(spark.read.parquet(path), "name", {"robot": "arm"}, "meta")
    assert [r["name"] for r in found.collect()] == ["a"]
    assert "EqualTo(meta_robot,arm)" in plan(found) and "meta:" not in plan(found).split("ReadSchema")[1]
    both = cat.scan_metadata_eq(spark.read.parquet(path), "name", {"robot": "arm", "n": 5}, "meta")
    assert [r["name"] for r in both.collect()] == ["a"]
    plain = cat.scan_metadata_eq(spark.createDataFrame(rows, "name string, meta string"), "name", {"robot": "arm"}, "meta")
    assert [r["name"] for r in plain.collect()] == ["a"]


def test_bucketed_features_are_not_shuffled_again(spark, tmp_path):
    keys = ["sequence_name"]
    held = QUERIES["hold_resample"](spark, SF)
    plain = al.finite_difference(held, keys, "t", {"r": "click"}, 1e6, hot=HotKeys((), 1_000_000))
    bucketed_table_write(held, "held_features", str(tmp_path / "held"), "sequence_name", "t", buckets=8)
    try:
        rows = bucketed_table_read(spark, "held_features")
        none = HotKeys((), 1_000_000)
        rates = al.finite_difference(rows, keys, "t", {"r": "click"}, 1e6, hot=none)
        assert "Exchange" not in plan(rates)
        cut = wi.sliding_windows(rows, keys, ["t"], 4, 2, "click", hot=none)
        assert "Exchange" not in plan(cut) and cut.count() > 0
        seconds = rates.groupBy(*keys).agg(F.max("r").alias("top"))
        assert "Exchange" not in plan(rows.join(seconds.hint("shuffle_merge"), keys))
        assert rates.exceptAll(plain).count() == 0 and plain.exceptAll(rates).count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS held_features")


def test_topics_reach_the_scan(spark):
    df = al.hold_resample(samples(spark, SF), "sequence_name", "t", "topic", "value", {"click": "click"}, HOUR_US)
    text = plan(df)
    assert "PushedFilters: [In(event_type, [click])" in text or "EqualTo(event_type,click)" in text
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "event_id" not in scan.split("Batched")[0] and "props" not in scan.split("Batched")[0]


@pytest.mark.parametrize("name,columns", [
    ("scan_dataset", {"doc_id", "lang"}),
    ("episode_index", {"source", "doc_id"}),
    ("pool_label_join", {"doc_id", "toxic"}),
    ("ingest_counters", {"doc_id", "lang", "n_chars", "quality", "toxic"}),
])
def test_scans_read_only_what_they_need(spark, name, columns):
    read = set()
    for line in plan(QUERIES[name](spark, SF)).splitlines():
        if "ReadSchema: struct<" in line:
            fields = line.split("ReadSchema: struct<")[1].rstrip("> ")
            read |= {f.split(":")[0] for f in fields.split(",") if ":" in f}
    assert read == columns


def test_only_user_code_runs_in_python(spark):
    allowed = {"pool_gated_attention", "score_bags", "encode_payloads"}
    lazy = [n for n in QUERIES if not n.startswith("stream_") and n not in (
        "train_bag_classifier", "pca_fit", "pca_apply", "pad_bags", "rank_failures", "rank_successes")]
    for name in lazy:
        text = plan(QUERIES[name](spark, SF))
        uses = any(op in text for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"))
        assert uses == (name in allowed), name
        assert "BatchEvalPython" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
