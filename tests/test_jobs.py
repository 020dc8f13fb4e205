"""Whole jobs on small recordings: materialise, pool, evaluate, select."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwise.operators import features as ft
from tickwise.operators import metrics as me
from tickwise.operators import scoring as sc
from tickwise.operators.scoring import byte_statistics
from tickwise.plans import evaluate as ev
from tickwise.plans import materialise as ma
from tickwise.plans import pools as po
from tickwise.plans.selection import select_acts
from tickwise.schema import CATALOG, SEQ, TIME
from tickwise.sources.tables import (
    commit_features, committed_features, committed_runs, feature_table_index, feature_table_write, incremental_todo,
)

TICK = 20_000_000
DROID = ("/observation/state/cartesian_position", "/observation/state/gripper_position")
FRACTAL = "/step/observation/"


def droid(spark, names, n=60):
    """Pose every tick, gripper every second one and starting two ticks late."""
    pose, grip = ft.pose_columns(DROID[0]), f"{DROID[1]}.end_effector.positions"
    poses = [(s, i * TICK, *[float(i + j) for j in range(7)]) for s in names for i in range(n)]
    grips = [(s, i * TICK, [float(i % 4 > 1)]) for s in names for i in range(2, n, 2)]
    return {
        DROID[0]: spark.createDataFrame(poses, f"{SEQ} string, {TIME} long, " + ", ".join(f"`{c}` double" for c in pose)),
        DROID[1]: spark.createDataFrame(grips, f"{SEQ} string, {TIME} long, `{grip}` array<float>"),
    }


def catalog(spark, dataset, flags):
    rows = [(s, dataset, {} if f is None else {"is_episode_successful": f}, []) for s, f in flags.items()]
    return spark.createDataFrame(rows, CATALOG)


def test_materialise_droid(spark):
    names = catalog(spark, "droid", {"e1": "true", "e2": "false", "gone": "true"})
    images = spark.createDataFrame([("e1", 5 * TICK, b"<a>"), ("e1", 30 * TICK, b"<b><c>")],
                                   f"{SEQ} string, {TIME} long, data binary")
    rows = ma.materialise("droid", droid(spark, ["e1", "e2"]), names, images=images, encoder_factory=byte_statistics)
    assert rows.count() == 2 * 58
    first = rows.where(f"{SEQ} = 'e1'").orderBy("tick").collect()
    assert [r["tick"] for r in first] == list(range(2, 60))
    kin = np.array([r["kin"] for r in first])
    assert kin.shape[1] == 15 and (kin[:, 0] == np.arange(2, 60)).all()
    assert (kin[0, 8:] == 0).all() and np.allclose(kin[1:, 8], 50.0) and kin[:, 7].max() == 1.0
    assert {tuple(r["cnn"]) for r in first if r["tick"] < 5} == {(0.0, 0.0, 0.0, 0.0)}
    assert {tuple(r["cnn"]) for r in first if 5 <= r["tick"] < 30} == {(3.0, 1.0, 0.0, 0.0)}
    assert {r["label"] for r in first} == {0.0}
    assert {r["label"] for r in rows.where(f"{SEQ} = 'e2'").collect()} == {1.0}
    status = ma.status_of(names, rows, "droid", None)
    assert tuple(me.ingest_counters(status, "dataset_id", "state", "frames").first()) == ("droid", 2, 0, 1, 0, 116)


def test_materialise_only_what_is_missing(spark, tmp_path):
    names = catalog(spark, "droid", {"e1": "true", "e2": "false"})
    root = str(tmp_path / "features")
    streams = droid(spark, ["e1", "e2"])
    feature_table_write(ma.materialise("droid", {t: s.where(f"{SEQ} = 'e1'") for t, s in streams.items()}, names), root,
                        "dataset_id")
    done = spark.read.parquet(root)
    more = ma.materialise("droid", streams, names, done)
    assert {r[SEQ] for r in more.select(SEQ).distinct().collect()} == {"e2"}
    assert ma.materialise("droid", streams, names, done, force=True).count() == 116
    feature_table_write(more, root, "dataset_id")
    rows, missing = feature_table_index(spark, root, ["droid", "nope"], "dataset_id")
    assert missing == ["nope"] and rows.count() == 116


def test_one_bad_payload_fails_one_sequence(spark):
    names = [f"e{i}" for i in range(40)]
    listed = catalog(spark, "droid", dict.fromkeys(names, "true"))
    images = spark.createDataFrame(
        [(s, i * TICK, b"poison" if (s, i) == ("e7", 10) else b"<a>") for s in names for i in range(0, 50, 2)],
        f"{SEQ} string, {TIME} long, data binary")

    def encoder():
        plain = byte_statistics()

        def encode(raw):
            if b"poison" in raw:
                raise ValueError("no image")
            return plain(raw)

        return encode

    assert images.count() == 1_000
    frames = sc.encode_payloads(images, "data", encoder, "cnn", "error")
    assert frames.where("error IS NULL AND cnn IS NOT NULL").count() == 999
    assert [tuple(r) for r in frames.where("cnn IS NULL").collect()] == [("e7", 10 * TICK, None, "ValueError: no image")]
    streams = droid(spark, names)
    rows, failed = ma.materialise_with_failures("droid", streams, listed, images=images, encoder_factory=encoder)
    assert [tuple(r) for r in failed.collect()] == [("e7", "ValueError: no image")]
    assert rows.select(SEQ).distinct().count() == 39 and rows.where(f"{SEQ} = 'e7'").count() == 0
    status = ma.status_of(listed, rows, "droid", None, failed)
    counted = me.ingest_counters(status, "dataset_id", "state", "frames").first()
    assert tuple(counted) == ("droid", 39, 0, 0, 1, 39 * 58)
    with pytest.raises(Exception, match="no image"):
        ma.materialise("droid", streams, listed, images=images, encoder_factory=encoder).collect()


def test_encoder_must_return_a_vector_per_payload(spark):
    rows = spark.createDataFrame([(i, b"x") for i in range(3)], "i long, data binary").coalesce(1)
    out = sc.encode_payloads(rows, "data", lambda: lambda raw: np.zeros((1, 2)), "v", "error")
    assert out.where("error IS NULL").count() == 3
    none = sc.encode_payloads(rows, "data", lambda: lambda raw: np.zeros((0, 2)), "v", "error")
    assert {r["error"] for r in none.collect()} == {"ValueError: encoder returned 0 vectors for 1 payloads"}


def test_run_that_died_between_two_datasets_is_built_again(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "seq string, dataset_id string, run string"
    docs = spark.createDataFrame([(f"s{i}", f"d{i % 2}") for i in range(20)], "seq string, dataset_id string")
    assert committed_features(spark, path) is None
    first = docs.where("seq < 's14'")
    assert commit_features(first, path, "dataset_id", "one")
    seen = committed_features(spark, path, schema)
    todo = incremental_todo(docs, seen, ["dataset_id", "seq"])
    # The rows of d0 are on disk when the task of d1 dies.
    feature_table_write(todo.where("dataset_id = 'd0'"), f"{path}/rows/run=two", "dataset_id")
    dying = todo.where(F.when(F.col("dataset_id") == "d1", F.raise_error(F.lit("lost"))).otherwise(F.lit(None)).isNull())
    with pytest.raises(Exception, match="lost"):
        commit_features(dying, path, "dataset_id", "two")
    assert committed_runs(spark, path) == ["one"]
    assert committed_features(spark, path, schema).count() == first.count()
    again = incremental_todo(docs, committed_features(spark, path, schema), ["dataset_id", "seq"])
    assert commit_features(again, path, "dataset_id", "two")
    assert not commit_features(docs, path, "dataset_id", "two")
    rows = committed_features(spark, path, schema)
    assert sorted(tuple(r) for r in rows.select("seq", "dataset_id").collect()) == sorted(tuple(r) for r in docs.collect())
    assert committed_runs(spark, path) == ["one", "two"]


def test_materialise_without_topics(spark):
    assert ma.aligned("droid", {"/other": spark.createDataFrame([("s", 0)], f"{SEQ} string, {TIME} long")}) is None


def test_materialise_fractal(spark):
    pose = ft.pose_columns(f"{FRACTAL}base_pose_tool_reached")
    base = f"{SEQ} string, {TIME} long"
    n = 6
    ticks = range(n)
    streams = {
        f"{FRACTAL}base_pose_tool_reached": spark.createDataFrame(
            [(s, i * TICK, *[0.1] * 7) for s in "ab" for i in ticks], base + "".join(f", `{c}` double" for c in pose)),
        f"{FRACTAL}gripper_closed": spark.createDataFrame(
            [(s, i * TICK, 0.25) for s in "ab" for i in ticks], f"{base}, `{FRACTAL}gripper_closed.floating32.data` double"),
        f"{FRACTAL}gripper_closedness_commanded": spark.createDataFrame(
            [(s, i * TICK, 1.0) for s in "ab" for i in ticks],
            f"{base}, `{FRACTAL}gripper_closedness_commanded.floating32.data` double"),
        f"{FRACTAL}natural_language_embedding": spark.createDataFrame(
            [("a", 0, [1.0]), ("a", TICK, [0.5] * 512), ("b", 0, [2.0])],
            f"{base}, `{FRACTAL}natural_language_embedding.text_embedding.values` array<float>"),
        "/step/reward": spark.createDataFrame(
            [(s, i * TICK, float(s == "a" and i == n - 1)) for s in "ab" for i in ticks],
            f"{base}, `/step/reward.floating32.data` double"),
        "/step/is_terminal": spark.createDataFrame(
            [(s, i * TICK, i == n - 1) for s in "ab" for i in ticks], f"{base}, `/step/is_terminal.boolean.data` boolean"),
    }
    names = catalog(spark, "fractal_rt1", {"a": None, "b": None})
    rows = ma.materialise("fractal_rt1", streams, names).collect()
    assert len(rows) == 2 * n and {len(r["kin"]) for r in rows} == {16}
    assert {round(r["kin"][15], 6) for r in rows} == {0.75}
    assert {r[SEQ]: r["label"] for r in rows} == {"a": 0.0, "b": 1.0}
    assert {r[SEQ]: r["nl_emb"] and len(r["nl_emb"]) for r in rows} == {"a": 512, "b": None}
    held = ma.aligned("fractal_rt1", streams)
    pools = po.pools_from_terminal(
        names, held, "fractal_rt1", ["tick"], "/step/reward.floating32.data", "/step/is_terminal.boolean.data")
    assert {(r[SEQ], r["outcome"]) for r in pools.collect()} == {("a", "success"), ("b", "failure")}


def test_pools_from_every_origin(spark):
    names = catalog(spark, "droid", {"a": "true", "b": "false", "c": None}).unionByName(
        catalog(spark, "reassemble", {"r": None, "q": None}))
    samples = spark.createDataFrame([("r", "/grasp_failure_label", True), ("r", "/grasp_failure_label", False)],
                                    f"{SEQ} string, topic string, v boolean")
    pools = po.build_pools(
        po.pools_from_metadata(names, "droid"),
        po.pools_from_topic(names, samples, "reassemble", "/grasp_failure_label", F.col("v")),
    )
    assert {tuple(r) for r in pools.collect()} == {
        ("droid", "success", "a"), ("droid", "failure", "b"),
        ("reassemble", "success", "r"), ("reassemble", "failure", "r")}


@pytest.fixture(scope="module")
def features(spark):
    """Two datasets of 60 and 40 sequences; the first channel tells the classes apart in one of them."""
    rng = np.random.default_rng(0)
    rows = []
    for ds, n, gap in (("a", 60, 2.0), ("b", 40, 0.0)):
        for i in range(n):
            y = float(i % 3 == 0)
            for t in range(40 if i else 7):
                rows.append((ds, f"{ds}{i:03d}", t, [float(x) for x in rng.normal([gap * y, 0, 0])], y))
    return spark.createDataFrame(
        rows, "dataset_id string, sequence_name string, timestamp_ns long, kin array<float>, label float")


def test_train_and_evaluate(spark, features):
    y = features.groupBy("dataset_id", SEQ).agg(F.max("label").alias("y"))
    pools = y.select("dataset_id", SEQ, F.when(F.col("y") > 0.5, "failure").otherwise("success").alias("outcome"))
    metrics, scores = ev.train_and_evaluate(
        features, pools, ev.Settings(length=10, stride=10, width=4, tail={"a": 0.5}))
    got = {r["dataset_id"]: r for r in metrics.collect()}
    assert set(got) == {"a", "b", "overall"}
    assert got["a"]["auc"] > 0.9 and got["a"]["class_separation"] > 0.3
    assert scores.select(SEQ).distinct().count() == scores.count()
    assert scores.where("p < 0 or p > 1").count() == 0


@pytest.fixture(scope="module")
def three_inputs(features):
    """The same with descriptors, one element of them not finite, and instructions in one dataset."""
    x = F.get("kin", F.lit(1)).cast("double")
    bad = (F.col(SEQ) == "a003") & (F.col(TIME) == 3)
    return features.withColumn("cnn", F.array(x * 2 + 1, F.when(bad, F.lit(float("nan"))).otherwise(x * x), F.lit(7.0))).withColumn(
        "nl_emb", F.when(F.col("dataset_id") == "a", F.array(x, F.lit(0.5))))


def scaler_of(ticks, length, stride):
    """Mean and deviation over all ticks of all complete windows, from windows that are built."""
    rows = []
    for seq in ticks.values():
        for start in range(0, len(seq) - length + 1, stride):
            rows += seq[start : start + length]
    m = np.array(rows, float)
    std = np.nanstd(m, axis=0)
    return np.nanmean(m, axis=0), np.where(std < 1e-6, 1.0, std)


def test_evaluate_stratified_on_three_inputs(spark, three_inputs, tmp_path):
    s = ev.Settings(length=10, stride=4, width=4, cnn_width=3, instruction_dim=2, without_instruction=("b",))
    path = str(tmp_path / "scaler")
    metrics, scores = ev.train_and_evaluate(three_inputs, None, s, scaler_path=path)
    got = {r["dataset_id"]: r for r in metrics.collect()}
    assert set(got) == {"a", "b", "overall"} and got["a"]["auc"] > 0.9
    split = {(r["dataset_id"], r[SEQ]): r["split"] for r in ev.assign(three_inputs, None, s).collect()}
    assert len(split) == 100 and {k: split[k] for k in split if k[1][1:] != "000"} == {
        (r["dataset_id"], r[SEQ]): r["split"] for r in scores.collect()}
    ticks = {"kin": {}, "cnn": {}}
    for r in three_inputs.orderBy("dataset_id", SEQ, TIME).collect():
        key = (r["dataset_id"], r[SEQ])
        if split[key] == "train":
            ticks["kin"].setdefault(key, []).append([*r["kin"], 0.0])
            ticks["cnn"].setdefault(key, []).append(r["cnn"])
    for stream, width in (("kin", 4), ("cnn", 3)):
        mean, std = scaler_of(ticks[stream], 10, 4)
        rows = spark.read.parquet(path).where(F.col("stream") == stream).orderBy("channel").collect()
        assert [r["channel"] for r in rows] == list(range(width))
        assert np.allclose([r["mean"] for r in rows], mean) and np.allclose([r["std"] for r in rows], std)


def test_evaluate_zero_shot(three_inputs):
    s = ev.Settings(length=10, stride=10, width=4)
    metrics, scores = ev.train_and_evaluate(three_inputs, None, s, ["a"], ["b"])
    assert {tuple(r) for r in scores.select("dataset_id", "split").distinct().collect()} == {
        ("a", "train"), ("a", "val"), ("b", "test")}
    assert {r["dataset_id"] for r in metrics.collect()} == {"b", "overall"}


def test_evaluate_splits_training_datasets_only(three_inputs):
    s = ev.Settings()
    assert {r["dataset_id"] for r in ev.assign(three_inputs, None, s, ["a"], ["a", "b"]).collect()} == {"a"}


def test_instruction_of_a_bag_is_its_first_one(spark, three_inputs):
    s = ev.Settings(instruction_dim=3, without_instruction=("b",))
    bags = spark.createDataFrame(
        [("a", "a001", [9.0]), ("b", "b001", [9.0]), ("a", "none", [9.0])], "dataset_id string, sequence_name string, features array<double>")
    got = {r[SEQ]: r["features"] for r in ev.with_instruction(bags, three_inputs, s).collect()}
    first = three_inputs.where(f"{SEQ} = 'a001' AND {TIME} = 0").first()["nl_emb"]
    assert got == {"a001": [9.0, *first, 0.0, 0.0], "b001": [9.0, 0, 0, 0, 1.0], "none": [9.0, 0, 0, 0, 0.0]}


def test_select_acts(spark):
    names = [(f"x_f{i % 2}_ep{i}", int(i < 6), 400, 10) for i in range(12)]
    seqs = spark.createDataFrame(names, f"{SEQ} string, label int, ticks long, n_windows long")
    windows = spark.createDataFrame(
        [(s, w, (0.1 + 0.09 * w * (i + 1) / 12) if y else 0.02 * i) for i, (s, y, _, m) in enumerate(names) for w in range(m)],
        f"{SEQ} string, window long, score double")
    assigned = seqs.where("label = 1").select(SEQ, F.lit("test").alias("split"))
    index = spark.createDataFrame([(f"f{i % 2}", i) for i in range(11)], "file string, episode long")
    acts = select_acts(seqs, windows, assigned, seqs.select(SEQ, "label"), index, "x_").collect()
    assert [r["label"] for r in acts] == [1, 0, 1, 0]
    assert [r[SEQ] for r in acts] == ["x_f1_ep5", "x_f0_ep6", "x_f0_ep4", "x_f1_ep7"]
    assert {r["duration"] for r in acts} == {8.0}
