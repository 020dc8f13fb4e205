"""Evaluation aggregates, traces and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.operators import metrics as me
from tickwise.operators import traces as tr
from tickwise.operators import windows as wi
from tickwise.operators.ordered import hot_keys
from tickwise.queries import query
from tickwise.queries.common import (
    FRAME_ORDER, FRAMES_SQL, PREFIX_SQL, SAMPLES_SQL, SCORED_SQL, SCORES_SQL, TAIL_SQL, frames, q6, r6, samples,
    scored_windows, scores, table, windows_sql,
)
from tickwise.session import staged

DS = ["dataset_id"]


def _round(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2.0::DOUBLE * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END"


def _steps(source: str) -> str:
    """Confusion counts of every distinct score of ``source`` as threshold, by brute force."""
    return f"""SELECT a.dataset_id, a.t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp,
        count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn
        FROM (SELECT DISTINCT dataset_id, p AS t FROM {source}) a JOIN {source} b ON a.dataset_id = b.dataset_id
        GROUP BY a.dataset_id, a.t"""


def _best(steps: str) -> str:
    return f"""SELECT dataset_id, CASE WHEN max(tp + fn) = 0 OR max(fp + tn) = 0 THEN 0.5
        ELSE first(t ORDER BY {_f1('tp', 'fp', 'fn')} DESC, t) END AS threshold FROM {steps} GROUP BY 1"""


_COUNTS = """count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
    count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p >= 0.5 AND y = 1) AS tp"""
_CELLS = f"{SCORES_SQL}, cells AS (SELECT dataset_id, {_COUNTS} FROM scores GROUP BY 1)"


def _auc(source: str) -> str:
    return f"""SELECT a.dataset_id, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS auc
        FROM {source} a JOIN {source} b ON a.dataset_id = b.dataset_id AND a.y = 1 AND b.y = 0 GROUP BY 1"""


@query("threshold_f1", f"WITH {SCORES_SQL}, steps AS ({_steps('scores')}) {_best('steps')}")
def threshold(spark, sf):
    return me.threshold_f1(scores(spark, sf), DS, "p", "y")


@query("confusion", f"WITH {_CELLS} SELECT * FROM cells")
def confusion(spark, sf):
    return me.confusion(scores(spark, sf), DS, "p", "y", 0.5)


@query("accuracy", f"WITH {_CELLS} SELECT dataset_id, {q6('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy FROM cells")
def accuracy(spark, sf):
    return _round(me.accuracy(scores(spark, sf), DS, "p", "y", 0.5), "accuracy")


@query("f1_score", f"WITH {_CELLS} SELECT dataset_id, {q6(_f1('tp', 'fp', 'fn'))} AS f1 FROM cells")
def f1(spark, sf):
    return _round(me.f1_score(scores(spark, sf), DS, "p", "y", 0.5), "f1")


@query("auc", f"WITH {SCORES_SQL}, areas AS ({_auc('scores')}) SELECT dataset_id, {q6('auc')} AS auc FROM areas")
def auc(spark, sf):
    return _round(me.auc(scores(spark, sf), DS, "p", "y"), "auc")


@query(
    "roc_curve",
    f"""WITH {SCORES_SQL}, steps AS ({_steps('scores')})
    SELECT dataset_id, t AS threshold, {q6('fp / (fp + tn)')} AS fpr, {q6('tp / (tp + fn)')} AS tpr FROM steps""",
)
def roc(spark, sf):
    return _round(me.roc_curve(scores(spark, sf), DS, "p", "y"), "fpr", "tpr")


_REPORT_SQL = f"""WITH {_CELLS}, c AS (
    SELECT dataset_id, tn + fp AS n0, fn + tp AS n1, tn + fp + fn + tp AS n, (tn + tp) / (tn + fp + fn + tp) AS acc,
        coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
        {_f1('tn', 'fn', 'fp')} AS f0, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1,
        coalesce(tp / nullif(fn + tp, 0), 0.0) AS r1, {_f1('tp', 'fp', 'fn')} AS f1 FROM cells)
""" + " UNION ALL ".join(
    f"SELECT dataset_id, '{name}' AS row, {q6(p)} AS precision, {q6(r)} AS recall, {q6(f)} AS f1, {n} AS support FROM c"
    for name, p, r, f, n in (
        ("success", "p0", "r0", "f0", "n0"),
        ("failure", "p1", "r1", "f1", "n1"),
        ("accuracy", "acc", "acc", "acc", "n"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "n"),
        ("weighted avg", "(p0 * n0 + p1 * n1) / n", "(r0 * n0 + r1 * n1) / n", "(f0 * n0 + f1 * n1) / n", "n"),
    )
)


@query("class_report", _REPORT_SQL)
def class_report(spark, sf):
    cells = me.confusion(scores(spark, sf), DS, "p", "y", 0.5)
    return _round(me.class_report(cells, DS), "precision", "recall", "f1")


_EVERY = """val AS (SELECT dataset_id, p, y FROM scores WHERE split = 'val'
                    UNION ALL SELECT 'overall', p, y FROM scores WHERE split = 'val'),
    test AS (SELECT dataset_id, p, y FROM scores WHERE split = 'test'
             UNION ALL SELECT 'overall', p, y FROM scores WHERE split = 'test')"""


@query(
    "metrics_per_dataset",
    f"""WITH {SCORES_SQL}, {_EVERY}, steps AS ({_steps('val')}), best AS ({_best('steps')}),
    g AS (SELECT threshold AS g FROM best WHERE dataset_id = 'overall'),
    rows AS (SELECT test.*, coalesce(threshold, g) AS thr, g FROM test LEFT JOIN best USING (dataset_id), g),
    c AS (
        SELECT dataset_id, max(thr) AS threshold, count(*) FILTER (p < thr AND y = 0) AS tn,
            count(*) FILTER (p >= thr AND y = 0) AS fp, count(*) FILTER (p < thr AND y = 1) AS fn,
            count(*) FILTER (p >= thr AND y = 1) AS tp, count(*) FILTER (p < g AND y = 0) AS gtn,
            count(*) FILTER (p >= g AND y = 0) AS gfp, count(*) FILTER (p < g AND y = 1) AS gfn,
            count(*) FILTER (p >= g AND y = 1) AS gtp, coalesce(avg(p) FILTER (y = 1), 0.0) AS mp,
            coalesce(avg(p) FILTER (y = 0), 0.0) AS mn FROM rows GROUP BY 1),
    areas AS ({_auc('test')})
    SELECT dataset_id, threshold, tn, fp, fn, tp, {q6('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy, {q6('auc')} AS auc,
           {q6(_f1('tp', 'fp', 'fn'))} AS f1, {q6(_f1('gtp', 'gfp', 'gfn'))} AS f1_global,
           {q6('(gtn + gtp) / (gtn + gfp + gfn + gtp)')} AS accuracy_global, {q6('mp')} AS mean_prob_on_pos,
           {q6('mn')} AS mean_prob_on_neg, {q6('mp - mn')} AS class_separation
    FROM c LEFT JOIN areas USING (dataset_id)""",
)
def per_dataset(spark, sf):
    s = scores(spark, sf)
    out = me.metrics_per_dataset(s.where("split = 'test'"), s.where("split = 'val'"), "dataset_id", "p", "y")
    return _round(out, "accuracy", "auc", "f1", "f1_global", "accuracy_global", "mean_prob_on_pos", "mean_prob_on_neg",
                  "class_separation")


@query(
    "class_separation",
    f"""WITH {SCORES_SQL}, m AS (SELECT dataset_id, coalesce(avg(p) FILTER (y = 1), 0.0) AS mp,
        coalesce(avg(p) FILTER (y = 0), 0.0) AS mn FROM scores GROUP BY 1)
    SELECT dataset_id, {q6('mp')} AS mean_prob_on_pos, {q6('mn')} AS mean_prob_on_neg, {q6('mp - mn')} AS class_separation
    FROM m""",
)
def separation(spark, sf):
    out = me.class_separation(scores(spark, sf), DS, "p", "y")
    return _round(out, "mean_prob_on_pos", "mean_prob_on_neg", "class_separation")


@query(
    "multi_seed_summary",
    f"""WITH {SCORES_SQL}, runs AS (
        SELECT 'r' || substr(md5(sequence_name::VARCHAR), 2, 1) AS run, dataset_id, avg(p) AS score,
               avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY 1, 2)
    SELECT dataset_id, {q6('avg(score)')} AS score_mean, {q6('stddev_pop(score)')} AS score_std,
           {q6('avg(accuracy)')} AS accuracy_mean, {q6('stddev_pop(accuracy)')} AS accuracy_std FROM runs GROUP BY 1""",
)
def seeds(spark, sf):
    s = scores(spark, sf).withColumn(
        "run", F.concat(F.lit("r"), F.substring(F.md5(F.col("sequence_name").cast("string")), 2, 1)))
    runs = s.groupBy("run", "dataset_id").agg(F.avg("p").alias("score")).join(
        me.accuracy(s, ["run", "dataset_id"], "p", "y", 0.5), ["run", "dataset_id"])
    out = me.multi_seed_summary(runs, DS, ["score", "accuracy"])
    return _round(out, "score_mean", "score_std", "accuracy_mean", "accuracy_std")


@query(
    "sequence_summary",
    f"WITH {FRAMES_SQL} SELECT seq, count(*) AS rows, {q6('avg(label)')} AS pos_ratio, 15::BIGINT AS n_features FROM frames GROUP BY 1",
)
def summary(spark, sf):
    return _round(me.sequence_summary(frames(spark, sf), ["seq"], "label", 15), "pos_ratio")


@query(
    "ingest_counters",
    """WITH s AS (
        SELECT lang AS dataset_id, n_chars, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'empty'
               WHEN quality IS NULL THEN 'skip' ELSE 'ok' END AS state FROM documents LEFT JOIN labels USING (doc_id))
    SELECT dataset_id, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'skip') AS skip,
           count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'fail') AS fail,
           coalesce(sum(n_chars) FILTER (state = 'ok'), 0)::BIGINT AS frames FROM s GROUP BY 1""",
)
def counters(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    state = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "empty").when(
        F.col("quality").isNull(), "skip").otherwise("ok")
    rows = joined.select(F.col("lang").alias("dataset_id"), state.alias("state"), "n_chars")
    return me.ingest_counters(rows, "dataset_id", "state", "n_chars")


@query(
    "window_counts",
    f"""WITH {windows_sql(50, 10)}
    SELECT CASE WHEN md5(seq::VARCHAR) < '8' THEN 'train' ELSE 'test' END AS split, count(DISTINCT seq) AS sequences,
           count(*) AS windows FROM (SELECT DISTINCT seq, win FROM ticks) GROUP BY 1""",
)
def counts(spark, sf):
    w = wi.sliding_windows(frames(spark, sf), ["seq"], FRAME_ORDER, 50, 10, "label").withColumn(
        "split", F.when(F.md5(F.col("seq").cast("string")) < "8", "train").otherwise("test"))
    return me.window_counts(w, "split", ["seq"])


# --- traces and rankings -------------------------------------------------------------------

SEQ = ["sequence_name"]


@query("prefix_bag_trace", f"WITH {PREFIX_SQL} SELECT sequence_name, n, {q6('p')} AS p FROM prefix")
def prefix(spark, sf):
    return _round(tr.prefix_bag_trace(scored_windows(spark, sf), SEQ, ["t"], "score"), "p")


def _tail(spark, sf, hot=None):
    return tr.tail_bag_trace(scored_windows(spark, sf), SEQ, ["t"], "score", hot=hot)


def _shape(spark, sf):
    hot = hot_keys(scored_windows(spark, sf), SEQ)
    return tr.trace_metrics(_tail(spark, sf, hot), SEQ, "n", "p", hot)


@query("tail_bag_trace", f"WITH {TAIL_SQL} SELECT sequence_name, n, k, {q6('p')} AS p FROM tail")
def tail(spark, sf):
    return _round(_tail(spark, sf), "p")


_SHAPE_SQL = TAIL_SQL + """,
placed AS (SELECT sequence_name, n - 2 AS i, count(*) OVER (PARTITION BY sequence_name) AS c, p FROM tail),
cross_at AS (
    SELECT sequence_name, avg(p) FILTER (i < greatest(1, c // 3)) AS p_start, avg(p) FILTER (i >= c - 2) AS p_end,
           max(p) FILTER (i = c - 1) AS final, max(p) AS max_p, min(p) AS min_p,
           min(i) FILTER (p > 0.3::DOUBLE) AS lo, min(i) FILTER (p >= 0.6::DOUBLE) AS hi,
           count(*) FILTER (p >= 0.3::DOUBLE AND p <= 0.6::DOUBLE) AS band_count
    FROM placed GROUP BY 1),
shape AS (
    SELECT * EXCLUDE (lo, hi), p_end - p_start AS rise,
           CASE WHEN hi >= lo THEN hi - lo + 1 WHEN hi IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS spread FROM cross_at)"""
_SHAPE_COLUMNS = ("p_start", "p_end", "final", "max_p", "min_p", "rise")


@query(
    "trace_metrics",
    f"WITH {_SHAPE_SQL} SELECT sequence_name, band_count, spread, "
    + ", ".join(f"{q6(c)} AS {c}" for c in _SHAPE_COLUMNS) + " FROM shape",
)
def shape(spark, sf):
    return _round(_shape(spark, sf), *_SHAPE_COLUMNS)


@query(
    "candidate_filter",
    f"""WITH {SAMPLES_SQL}, seqs AS (
        SELECT sequence_name, count(*) AS ticks, count(*) // 15 AS n_windows,
               CASE WHEN max(value) > 250 THEN 1 ELSE 0 END AS label FROM samples GROUP BY 1),
    listed AS (SELECT DISTINCT sequence_name, CASE WHEN value > 200 THEN 1 ELSE 0 END AS label FROM samples
               WHERE topic = 'error')
    SELECT sequence_name, ticks, n_windows, label FROM seqs WHERE ticks BETWEEN 60 AND 75 AND n_windows >= 4
    AND (sequence_name, label) IN (SELECT (sequence_name, label) FROM listed)""",
)
def candidates(spark, sf):
    rows = samples(spark, sf)
    seqs = rows.groupBy("sequence_name").agg(
        F.count(F.lit(1)).alias("ticks"), F.expr("count(1) div 15").alias("n_windows"),
        F.when(F.max("value") > 250, 1).otherwise(0).alias("label"))
    listed = rows.where("topic = 'error'").select(
        "sequence_name", F.when(F.col("value") > 200, 1).otherwise(0).alias("label"))
    return tr.candidate_filter(seqs, listed, SEQ, "label", "ticks", "n_windows", 60, 75, 4)


# Limits that suit the given scores; the defaults are in the operator.
_STRICT = {"start": 0.45, "end": 0.45, "rise": 0.06}
_RELAXED = {"start": 0.45, "end": 0.40, "rise": 0.02}


def _passing(rule: dict[str, float]) -> str:
    return f"p_start < {rule['start']} AND p_end > {rule['end']} AND rise > {rule['rise']}"


@query(
    "rank_failures",
    f"""WITH {_SHAPE_SQL}, enough AS (SELECT count(*) >= 2 AS ok FROM shape WHERE {_passing(_STRICT)}),
    chosen AS (SELECT shape.* FROM shape, enough WHERE CASE WHEN ok THEN {_passing(_STRICT)} ELSE {_passing(_RELAXED)} END)
    SELECT sequence_name, spread, {q6('rise')} AS rise,
           row_number() OVER (ORDER BY spread >= 2 DESC, rise DESC, spread DESC, sequence_name) AS rank FROM chosen""",
)
def failures(spark, sf):
    m = staged(_shape(spark, sf).select("sequence_name", "p_start", "p_end", "rise", "spread"), "traces")
    return tr.rank_failures(m, "sequence_name", _STRICT, _RELAXED).select(
        "sequence_name", "spread", r6("rise").alias("rise"), "rank")


@query(
    "rank_successes",
    f"""WITH {_SHAPE_SQL} SELECT sequence_name, {q6('max_p')} AS max_p,
    row_number() OVER (ORDER BY max_p, sequence_name) AS rank FROM shape WHERE max_p < 0.5::DOUBLE""",
)
def successes(spark, sf):
    m = _shape(spark, sf).select("sequence_name", "max_p")
    return tr.rank_successes(m, "sequence_name", 0.5).select("sequence_name", r6("max_p").alias("max_p"), "rank")


@query(
    "two_pass_selection",
    f"""WITH {_SHAPE_SQL}, fails AS (SELECT user_id AS sequence_name FROM events GROUP BY 1 HAVING max(value) > 150),
    first_pass AS (SELECT sequence_name, avg(score) FILTER (n > m - k) AS score FROM sized
                   WHERE sequence_name IN (SELECT sequence_name FROM fails) GROUP BY 1),
    best AS (SELECT * FROM first_pass ORDER BY score DESC, sequence_name LIMIT 20)
    SELECT sequence_name, {q6('score')} AS score, {q6('rise')} AS rise, spread,
           row_number() OVER (ORDER BY spread >= 2 DESC, rise DESC, score DESC, sequence_name) AS rank
    FROM best JOIN shape USING (sequence_name)""",
)
def two_pass(spark, sf):
    labels = samples(spark, sf).groupBy("sequence_name").agg(
        F.when(F.max("value") > 150, 1).otherwise(0).alias("label"))
    windows = scored_windows(spark, sf)
    hot = hot_keys(windows, SEQ)
    out = tr.two_pass_selection(windows, SEQ, "t", "score", labels, "sequence_name", "label", hot=hot)
    return out.select("sequence_name", r6("score").alias("score"), r6("rise").alias("rise"), "spread", "rank")
