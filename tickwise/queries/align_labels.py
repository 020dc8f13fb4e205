"""Time alignment, series operators and label derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.operators import align as al
from tickwise.operators import labels as lb
from tickwise.operators.ordered import hot_keys, ordered_scan
from tickwise.operators.traces import prefix_bag_trace
from tickwise.queries import query
from tickwise.queries.common import (
    DATASET_OF_USER_SQL, FRAMES_SQL, HOUR_US, PREFIX_SQL, SAMPLES_SQL, TOPICS, dataset_of_user, frames, q6, r6,
    samples, scored_windows, table,
)

GRID_SQL = SAMPLES_SQL + f""",
bounds AS (SELECT sequence_name, min(t) AS t0, max(t) AS t1 FROM samples GROUP BY 1),
ticks AS (SELECT sequence_name, t0, unnest(range(0, (t1 - t0) // {HOUR_US} + 1)) AS tick FROM bounds),
grid AS (SELECT sequence_name, tick, t0 + tick * {HOUR_US} AS t FROM ticks),
held AS (
    SELECT g.sequence_name, g.tick, g.t, {', '.join(f'{t}.value AS {t}' for t in TOPICS)} FROM grid g
""" + "\n".join(
    f"    ASOF LEFT JOIN (SELECT * FROM samples WHERE topic = '{t}') {t} "
    f"ON g.sequence_name = {t}.sequence_name AND g.t >= {t}.t" for t in TOPICS
) + ")"

HELD_SQL = f"WITH {GRID_SQL} SELECT * FROM held"


def held(spark, sf):
    """All topics of a user on an hourly grid."""
    return al.hold_resample(
        samples(spark, sf), "sequence_name", "t", "topic", "value", {t: t for t in TOPICS}, HOUR_US)


@query("hold_resample", HELD_SQL)
def hold(spark, sf):
    return held(spark, sf)


@query("hold_chunked_equal", HELD_SQL)
def hold_chunked(spark, sf):
    return al.hold_resample_chunked(
        samples(spark, sf), "sequence_name", "t", "topic", "value", {t: t for t in TOPICS}, HOUR_US, 24 * HOUR_US)


@query(
    "ffill_bfill",
    f"""WITH {SAMPLES_SQL}, clicks AS (
        SELECT sequence_name, t, CASE WHEN topic = 'click' THEN value END AS click FROM samples)
    SELECT sequence_name, t, coalesce(
        last_value(click IGNORE NULLS) OVER (PARTITION BY sequence_name ORDER BY t),
        first_value(click IGNORE NULLS) OVER (
            PARTITION BY sequence_name ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS click
    FROM clicks""",
)
def fill(spark, sf):
    rows = samples(spark, sf).select(
        "sequence_name", "t", F.when(F.col("topic") == "click", F.col("value")).alias("click"))
    return al.fill_both(rows, ["sequence_name"], ["t"], {"click": "click"})


@query(
    "finite_difference",
    f"""WITH {SAMPLES_SQL}, steps AS (
        SELECT sequence_name, t, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM samples
        WINDOW w AS (PARTITION BY sequence_name ORDER BY t))
    SELECT sequence_name, t, {q6('CASE WHEN t - pt > 0 THEN (value - pv) / ((t - pt) / 1e6::DOUBLE) ELSE 0.0::DOUBLE END')}
           AS rate FROM steps""",
)
def difference(spark, sf):
    rows = samples(spark, sf).select("sequence_name", "t", "value")
    out = al.finite_difference(rows, ["sequence_name"], "t", {"rate": "value"}, 1e6)
    return out.select("sequence_name", "t", r6("rate").alias("rate"))


@query(
    "linear_interp_trace",
    f"""WITH {PREFIX_SQL}, asked AS (
        SELECT sequence_name, n - 1 AS i, (n - 1) / 3.0::DOUBLE AS x, m FROM scored),
    placed AS (SELECT *, greatest(2, least(floor(x)::BIGINT, m)) AS lo FROM asked),
    pairs AS (SELECT *, greatest(2, least(lo + 1, m)) AS hi FROM placed)
    SELECT a.sequence_name, a.i,
           {q6('coalesce(CASE WHEN lo = hi THEN l.p ELSE (1 - (x - floor(x))) * l.p + (x - floor(x)) * h.p END, 0.0)')} AS p_at
    FROM pairs a LEFT JOIN prefix l ON a.sequence_name = l.sequence_name AND a.lo = l.n
    LEFT JOIN prefix h ON a.sequence_name = h.sequence_name AND a.hi = h.n""",
)
def interpolate(spark, sf):
    windows = scored_windows(spark, sf)
    hot = hot_keys(windows, ["sequence_name"])
    trace = prefix_bag_trace(windows, ["sequence_name"], ["t"], "score", hot=hot)
    positions = ordered_scan(windows, ["sequence_name"], ["t"], index="i", hot=hot).select(
        "sequence_name", "i", (F.col("i") / 3.0).alias("x"))
    out = al.linear_interp_trace(positions, trace, "sequence_name", "x", "n", "p", 2, hot=hot)
    return out.select("sequence_name", "i", r6("p_at").alias("p_at"))


@query(
    "fractional_resample",
    f"""WITH {SAMPLES_SQL}, placed AS (
        SELECT sequence_name, value, row_number() OVER (PARTITION BY sequence_name ORDER BY t) - 1 AS i,
               count(*) OVER (PARTITION BY sequence_name) AS n FROM samples),
    asked AS (SELECT sequence_name, n, unnest(range(0, 30)) AS k FROM (SELECT DISTINCT sequence_name, n FROM placed))
    SELECT a.sequence_name, a.k::INTEGER AS k, p.i AS idx, p.value FROM asked a JOIN placed p
    ON a.sequence_name = p.sequence_name AND p.i = round_even(a.k / 29.0::DOUBLE * (a.n - 1), 0)::BIGINT""",
)
def fractions(spark, sf):
    placed = ordered_scan(samples(spark, sf), ["sequence_name"], ["t"], index="idx").select(
        "sequence_name", "idx", "value")
    lengths = placed.groupBy("sequence_name").agg(F.count(F.lit(1)).alias("n"))
    return al.fractional_resample(placed, lengths, "sequence_name", "idx", "n", 30).select(
        "sequence_name", "k", "idx", "value")


@query(
    "jump_segment",
    f"""WITH {SAMPLES_SQL}, placed AS (
        SELECT sequence_name, t, value, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY sequence_name) AS n,
               CASE WHEN abs(value - lag(value) OVER w) > 100 THEN 1 ELSE 0 END AS jump FROM samples
        WINDOW w AS (PARTITION BY sequence_name ORDER BY t)),
    cut AS (SELECT *, sum(jump) OVER (PARTITION BY sequence_name ORDER BY idx)::BIGINT AS segment FROM placed),
    segs AS (SELECT sequence_name, segment, min(idx) AS lo, max(idx) + 1 AS hi, max(n) AS n FROM cut GROUP BY 1, 2),
    held AS (SELECT *, least(20, n - 1) AS c FROM segs WHERE lo <= least(20, n - 1) AND least(20, n - 1) < hi)
    SELECT sequence_name, t, value, idx, cut.segment FROM cut JOIN held USING (sequence_name)
    WHERE idx >= CASE WHEN hi - lo < 12 THEN greatest(0, c - 12) ELSE lo END
      AND idx < CASE WHEN hi - lo < 12 THEN least(held.n, c + 12) ELSE hi END""",
)
def segment(spark, sf):
    rows = samples(spark, sf).select("sequence_name", "t", "value")
    anchors = rows.select("sequence_name").distinct().withColumn("at", F.lit(20))
    return al.jump_segment(rows, ["sequence_name"], ["t"], "value", anchors, "at", 100.0, 12,
                           hot_keys(rows, ["sequence_name"]))


# --- labels --------------------------------------------------------------------------------

def _flagged(spark, sf):
    flag = F.when(F.col("topic") == "error", F.col("value") > 60)
    return samples(spark, sf).withColumn("/grasp_failure_label.boolean.data", flag).withColumnRenamed(
        "t", "timestamp_ns")


_FILLED_FLAG_SQL = SAMPLES_SQL + """,
flags AS (
    SELECT sequence_name, t, topic, value, CASE WHEN topic = 'error' THEN (value > 60)::INTEGER END AS f FROM samples),
filled AS (
    SELECT sequence_name, t, topic, value, coalesce(
        last_value(f IGNORE NULLS) OVER (PARTITION BY sequence_name ORDER BY t),
        first_value(f IGNORE NULLS) OVER (
            PARTITION BY sequence_name ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS label
    FROM flags)"""


@query("label_bool_topic", f"WITH {_FILLED_FLAG_SQL} SELECT sequence_name, t, label FROM filled")
def bool_topic(spark, sf):
    out = lb.label_bool_topic(
        _flagged(spark, sf), lb.FLAG_COLUMNS, lb.SUCCESS_COLUMN, ["sequence_name"], "timestamp_ns", "label")
    return out.select("sequence_name", F.col("timestamp_ns").alias("t"), "label")


@query(
    "label_metadata",
    """SELECT doc_id, CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def metadata(spark, sf):
    catalog = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_ok"))
    return lb.label_metadata(table(spark, sf, "documents").select("doc_id"), catalog, "doc_id", "is_ok", "label")


_ENDS_SQL = """ends AS (
    SELECT sequence_name, coalesce(
        arg_max(CASE WHEN topic = 'purchase' OR value > 80 THEN value - 60 ELSE 0.0 END, t) FILTER (topic = 'signup'),
        arg_max(CASE WHEN topic = 'purchase' OR value > 80 THEN value - 60 ELSE 0.0 END, t)) AS reward
    FROM samples GROUP BY 1)"""
_TERMINAL_SQL = f"{SAMPLES_SQL}, {_ENDS_SQL}"


def _rewarded(spark, sf):
    reward = F.when((F.col("topic") == "purchase") | (F.col("value") > 80), F.col("value") - 60).otherwise(0.0)
    return samples(spark, sf).withColumns({
        "/step/reward.data": reward, "/step/is_terminal.data": F.col("topic") == "signup",
    }).withColumnRenamed("t", "timestamp_ns")


@query(
    "label_terminal",
    f"""WITH {_TERMINAL_SQL} SELECT sequence_name, t, CASE WHEN reward > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS label
    FROM samples JOIN ends USING (sequence_name)""",
)
def terminal(spark, sf):
    out = lb.label_terminal(
        _rewarded(spark, sf), "sequence_name", ["timestamp_ns"], "/step/reward.data", "/step/is_terminal.data", "label")
    return out.select("sequence_name", F.col("timestamp_ns").alias("t"), "label")


@query(
    "label_dispatch",
    f"""WITH {_FILLED_FLAG_SQL}, {_ENDS_SQL}
    SELECT {DATASET_OF_USER_SQL} AS dataset_id, sequence_name, t,
           CASE sequence_name % 3 WHEN 0 THEN label WHEN 1 THEN CASE WHEN reward > 0 THEN 0.0 ELSE 1.0 END
           ELSE 0.0 END::DOUBLE AS label
    FROM filled JOIN ends USING (sequence_name)""",
)
def dispatch(spark, sf):
    rows = _flagged(spark, sf).withColumn("dataset_id", dataset_of_user())
    rewarded = _rewarded(spark, sf).select(
        "sequence_name", "timestamp_ns", "`/step/reward.data`", "`/step/is_terminal.data`")
    rows = rows.join(rewarded, ["sequence_name", "timestamp_ns"])
    adapters = {
        "ds0": lambda d: lb.label_bool_topic(
            d, lb.FLAG_COLUMNS, lb.SUCCESS_COLUMN, ["sequence_name"], "timestamp_ns", "label"),
        "ds1": lambda d: lb.label_terminal(
            d, "sequence_name", ["timestamp_ns"], "/step/reward.data", "/step/is_terminal.data", "label"),
        "ds2": lambda d: lb.label_terminal(d, "sequence_name", ["timestamp_ns"], None, None, "label"),
    }
    out = lb.label_dispatch(rows, adapters, "dataset_id", ["ds0", "ds1", "ds2"])
    return out.select("dataset_id", "sequence_name", F.col("timestamp_ns").alias("t"), "label")


@query("sequence_label", f"WITH {FRAMES_SQL} SELECT seq, CASE WHEN max(label) > 0.5 THEN 1 ELSE 0 END AS seq_label FROM frames GROUP BY 1")
def of_sequence(spark, sf):
    return lb.sequence_label(frames(spark, sf), ["seq"], "label")
