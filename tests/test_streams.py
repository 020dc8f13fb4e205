"""Streams over several files give the batch result, and their sequences end."""

import pytest
from pyspark.sql import functions as F

from tickwise.operators import align as al
from tickwise.operators import traces as tr
from tickwise.streaming import hold as sh
from tickwise.streaming import monitors as mo
from tickwise.streaming.run import read_files, replay, run_to_table

SAMPLES = "seq string, topic string, t long, v double"
MINUTE = 60_000_000


@pytest.fixture(scope="module")
def recorded(spark):
    """Samples of three sequences over two minutes; the epoch itself would be late for a first watermark."""
    rows = [(f"s{i % 3}", "ab"[(i // 3) % 2], (i * 7 - (i % 3) * 7) * 1_000, float((i * 37) % 100) / 100) for i in range(120)]
    return spark.createDataFrame(rows, SAMPLES)


def files(spark, folder, *parts):
    for part in parts:
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(folder)
    return read_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def left_behind(spark, checkpoint, *names):
    return sum(spark.read.format("statestore").option("stateVarName", n).load(checkpoint).count() for n in names)


@pytest.mark.parametrize("step", [7_000, 10_000])
def test_hold_equals_the_batch_result_and_leaves_no_state(spark, recorded, step):
    stream = replay(recorded, "t", 4, end_after=10 * MINUTE)
    out = sh.stream_hold_resample(stream, "seq", "t", "topic", "v", ["a", "b"], step, idle_ms=300_000)
    done, checkpoint = run_to_table(out, "hold")
    assert rows(done) == rows(al.hold_resample(recorded, "seq", "t", "topic", "v", {"a": "a", "b": "b"}, step))
    assert left_behind(spark, checkpoint, "grid") == 0


def test_waiting_tick_comes_out_by_timer_alone(spark, tmp_path):
    start = 1_000_000_000
    stream = files(
        spark, str(tmp_path / "idle"), [("old", "a", start, 1.0), ("old", "a", start + 10_000_000, 2.0)],
        [("new", "a", start + 900_000_000, 3.0)], [("new", "a", start + 901_000_000, 4.0)],
    )
    done, checkpoint = run_to_table(sh.stream_hold_resample(stream, "seq", "t", "topic", "v", ["a"], 10_000_000, idle_ms=60_000), "idle")
    assert ("old", 1, start + 10_000_000, 2.0) in rows(done)
    state = spark.read.format("statestore").option("stateVarName", "grid").load(checkpoint)
    assert [r["seq"] for r in state.select("key.seq").collect()] == ["new"]


def test_timer_of_a_sequence_that_goes_on_is_set_anew(spark, tmp_path):
    start = 1_000_000_000
    parts = [[("s", "a", start + i * 40_000_000, float(i)), ("other", "a", start + i * 40_000_000, 0.0)] for i in range(5)]
    parts.append([("other", "a", start + 2_000_000_000, 0.0)])
    stream = files(spark, str(tmp_path / "on"), *parts)
    done, _ = run_to_table(sh.stream_hold_resample(stream, "seq", "t", "topic", "v", ["a"], 40_000_000, idle_ms=60_000), "on")
    assert [r for r in rows(done) if r[0] == "s"] == [("s", i, start + i * 40_000_000, float(i)) for i in range(5)]


def test_late_samples_are_a_table_of_their_own(spark, tmp_path):
    base = 10_000_000
    parts = (
        [("s", "a", base, 1.0), ("s", "a", base + 25_000, 2.0), ("s", "x", base + 1, 0.0), ("s", "a", None, 5.0), (None, "a", base, 5.0)],
        [("s", "a", base + 5_000, 9.0), ("s", "b", base + 20_000, None), ("s", "a", base + 40_000, 3.0), ("gone", "a", base - 7_000, 4.0)],
        [("s", "b", base + 41_000, 7.0)],
    )
    stream = files(spark, str(tmp_path / "late"), *parts)
    tagged, _ = run_to_table(sh.stream_hold_tagged(stream, "seq", "t", "topic", "v", ["a", "b"], 10_000, idle_ms=600_000), "late", ["kind"])
    late = sh.late_of(tagged, "seq", "t")
    # The watermark of the second batch is the newest sample of the first.
    assert rows(late) == rows(spark.createDataFrame(
        [("s", base + 5_000, "a", 9.0, 15_000), ("s", base + 20_000, "b", None, 0), ("gone", base - 7_000, "a", 4.0, 32_000)],
        "seq string, t long, topic string, v double, behind long"))
    assert rows(sh.ticks_of(tagged).select("tick", "a", "b")) == [(0, 1.0, None), (1, 1.0, None), (2, 1.0, None), (3, 2.0, None), (4, 3.0, None)]
    asked = sum(r[1] in ("a", "b") and r[0] is not None and r[2] is not None for part in parts for r in part)
    used = asked - late.count()
    assert used == 4


def test_samples_in_any_order_are_used_or_late(spark, recorded):
    stream = replay(recorded, "t", 5, end_after=10 * MINUTE, order=(1, 0, 4, 2, 3))
    tagged, checkpoint = run_to_table(sh.stream_hold_tagged(stream, "seq", "t", "topic", "v", ["a", "b"], 7_000, idle_ms=300_000), "any")
    late = sh.late_of(tagged, "seq", "t").drop("behind")
    assert 0 < late.count() < recorded.count()
    used = recorded.join(late.withColumnsRenamed({"value": "v"}), ["seq", "t", "topic", "v"], "left_anti")
    assert used.count() + late.count() == recorded.count()
    assert rows(sh.ticks_of(tagged)) == rows(al.hold_resample(used, "seq", "t", "topic", "v", {"a": "a", "b": "b"}, 7_000))
    assert left_behind(spark, checkpoint, "grid") == 0


def test_prefix_monitor(spark, recorded):
    out = mo.stream_prefix_monitor(replay(recorded, "t", 4, end_after=10 * MINUTE), "seq", "t", "v", idle_ms=300_000)
    done, checkpoint = run_to_table(out, "prefix")
    assert rows(done) == rows(tr.prefix_bag_trace(recorded, ["seq"], ["t"], "v"))
    assert left_behind(spark, checkpoint, "total") == 0


def test_tail_monitor(spark, recorded):
    out = mo.stream_tail_monitor(replay(recorded, "t", 4, end_after=10 * MINUTE), "seq", "t", "v", 5, idle_ms=300_000)
    done, checkpoint = run_to_table(out, "tail")
    assert rows(done) == rows(tr.tail_bag_trace(recorded, ["seq"], ["t"], "v", k=5).select("seq", "n", "p"))
    assert left_behind(spark, checkpoint, "total", "kept") == 0


def test_alerts_report_each_change_once(spark, recorded):
    out = mo.stream_alerts(replay(recorded, "t", 4, end_after=10 * MINUTE), "seq", "t", "v", 0.5, idle_ms=300_000)
    done, checkpoint = run_to_table(out, "alerts")
    trace = tr.prefix_bag_trace(recorded, ["seq"], ["t"], "v").orderBy("seq", "n").collect()
    expected, last = [], {}
    for r in trace:
        level = "safe" if r["p"] < 0.25 else "warn" if r["p"] < 0.5 else "alarm"
        if last.get(r["seq"]) != level:
            expected.append((r["seq"], r["n"], round(r["p"], 9), level))
        last[r["seq"]] = level
    assert rows(done) == sorted(expected, key=str)
    assert left_behind(spark, checkpoint, "total", "last") == 0


def test_closed_monitor_begins_anew_and_ignores_nulls(spark, tmp_path):
    start = 1_000_000_000
    stream = files(
        spark, str(tmp_path / "anew"), [("s", "", start, 0.2), ("s", "", start + 1, 0.4), ("s", "", start + 2, None), (None, "", start, 0.9)],
        [("t", "", start + 900_000_000, 0.1)], [("s", "", start + 901_000_000, 0.8), ("s", "", start + 902_000_000, 0.6), ("s", "", None, 0.5)],
    )
    done, _ = run_to_table(mo.stream_prefix_monitor(stream, "seq", "t", "v", warm_up=1, idle_ms=60_000), "anew")
    assert rows(done.where("seq = 's'").select("n", "p")) == [(1, 0.2), (1, 0.8), (2, 0.3), (2, 0.7)]


def test_replay_of_nothing(spark):
    empty = spark.createDataFrame([], SAMPLES)
    done, _ = run_to_table(sh.stream_hold_resample(replay(empty, "t", 3, end_after=5), "seq", "t", "topic", "v", ["a"], 10), "nothing")
    assert done.count() == 0
    assert replay(empty.withColumn("x", F.lit(1)), "t", 2).columns == ["seq", "topic", "t", "v", "x"]
