"""Structured Streaming counterparts, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.operators.align import micros
from tickwise.queries import query
from tickwise.queries.align_labels import HELD_SQL
from tickwise.queries.common import HOUR_US, PREFIX_SQL, SCORED_SQL, TOPICS, q6, r6, table
from tickwise.streaming.hold import late_of, stream_hold_tagged, ticks_of
from tickwise.streaming.monitors import (
    stream_alerts, stream_prefix_monitor, stream_tail_monitor, stream_tumbling,
)
from tickwise.streaming.run import read_files, replay, run_to_table


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return read_files(spark, sf, schema, "events.parquet").select(
        F.col("user_id").alias("sequence_name"), F.col("event_type").alias("topic"),
        micros(F.col("ts")).alias("t"), F.col("ts").cast("timestamp").alias("at"), "value")


SLICES = 2
# Longer than any pause in the recordings: a sequence closes only after their end.
IDLE_MS = 400 * 24 * 3_600_000


def _samples(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("sequence_name"), F.col("event_type").alias("topic"), micros(F.col("ts")).alias("t"), "value")


def _replayed(rows, slices=SLICES, order=None):
    return replay(rows, "t", slices, end_after=2_000 * IDLE_MS, order=order)


def _scored(spark, sf):
    score = (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score")
    return _replayed(_samples(spark, sf).select("sequence_name", "t", score))


def _hold(spark, sf, slices=SLICES, order=None):
    stream = stream_hold_tagged(
        _replayed(_samples(spark, sf), slices, order), "sequence_name", "t", "topic", "value", TOPICS, HOUR_US, idle_ms=IDLE_MS)
    return run_to_table(stream, "hold")[0]


@query("stream_hold_resample", HELD_SQL)
def hold(spark, sf):
    return ticks_of(_hold(spark, sf))


@query(
    "stream_late_samples",
    f"""WITH samples AS (
        SELECT user_id AS sequence_name, epoch_us(ts) AS t, event_type AS topic, value,
               least((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 3 // greatest(max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER (), 1), 2) AS slice
        FROM events),
    before AS (
        SELECT sequence_name, min(t) AS t0, max(t) AS last_t FROM samples
        WHERE slice IN (0, 2) AND topic IN ({", ".join(f"'{t}'" for t in TOPICS)}) GROUP BY 1),
    settled AS (
        SELECT s.*, coalesce(t0 + ((last_t - t0 + {HOUR_US} - 1) // {HOUR_US} - 1) * {HOUR_US}, (SELECT max(t) // 1000 * 1000 FROM samples WHERE slice <> 1)) AS upto,
               t0 IS NULL AS fresh
        FROM samples s LEFT JOIN before USING (sequence_name) WHERE slice = 1 AND topic IN ({", ".join(f"'{t}'" for t in TOPICS)}))
    SELECT sequence_name, t, topic, value, upto - t AS behind FROM settled WHERE CASE WHEN fresh THEN t < upto ELSE t <= upto END""",
)
def late(spark, sf):
    return late_of(_hold(spark, sf, 3, (0, 2, 1)), "sequence_name", "t")


@query(
    "stream_tumbling",
    f"""WITH chunks AS (
        SELECT user_id AS sequence_name, epoch_us(ts) // {5 * HOUR_US} AS chunk, count(*) AS n, sum(value) AS total
        FROM events GROUP BY 1, 2)
    SELECT sequence_name, chunk, n, {q6('total')} AS total FROM chunks
    WHERE (chunk + 1) * {5 * HOUR_US} <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - {HOUR_US} FROM events)""",
)
def tumbling(spark, sf):
    out = stream_tumbling(
        _events(spark, sf), "sequence_name", "at", "5 hours", "1 hour",
        {"n": F.count(F.lit(1)), "total": F.sum("value")})
    done, _ = run_to_table(out, "tumbling")
    chunk = F.expr(f"unix_micros(start) div {5 * HOUR_US}")
    return done.select("sequence_name", chunk.alias("chunk"), "n", r6("total").alias("total"))


@query("stream_prefix_monitor", f"WITH {PREFIX_SQL} SELECT sequence_name, n, {q6('p')} AS p FROM prefix")
def prefix(spark, sf):
    done, _ = run_to_table(stream_prefix_monitor(_scored(spark, sf), "sequence_name", "t", "score", idle_ms=IDLE_MS), "prefix")
    return done.withColumn("p", r6("p"))


@query(
    "stream_tail_monitor",
    f"""WITH {SCORED_SQL}, last20 AS (
        SELECT sequence_name, n, avg(score) OVER (PARTITION BY sequence_name ORDER BY n ROWS 19 PRECEDING) AS p FROM scored
        QUALIFY n >= 2)
    SELECT sequence_name, n, {q6('p')} AS p FROM last20""",
)
def tail(spark, sf):
    done, _ = run_to_table(stream_tail_monitor(_scored(spark, sf), "sequence_name", "t", "score", 20, idle_ms=IDLE_MS), "tail")
    return done.withColumn("p", r6("p"))


@query(
    "stream_alerts",
    f"""WITH {PREFIX_SQL}, levels AS (
        SELECT sequence_name, n, p, CASE WHEN p < 0.25::DOUBLE THEN 'safe' WHEN p < 0.5::DOUBLE THEN 'warn' ELSE 'alarm' END AS level
        FROM prefix),
    marked AS (SELECT *, lag(level) OVER (PARTITION BY sequence_name ORDER BY n) AS was FROM levels)
    SELECT sequence_name, n, {q6('p')} AS p, level FROM marked WHERE was IS DISTINCT FROM level""",
)
def alerts(spark, sf):
    done, _ = run_to_table(stream_alerts(_scored(spark, sf), "sequence_name", "t", "score", 0.5, idle_ms=IDLE_MS), "alerts")
    return done.withColumn("p", r6("p"))
