"""Windows, bags, pooling and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.functions import vectors as vec
from tickwise.operators import pooling as pl
from tickwise.operators import scoring as so
from tickwise.operators import windows as wi
from tickwise.operators.ordered import hot_keys
from tickwise.operators.splits import split_stratified
from tickwise.queries import query
from tickwise.queries.common import (
    CELLS_SQL, DESCRIPTORS_SQL, FRAME_ORDER, descriptors, frames, q6, r6, table, windows_sql,
)
from tickwise.queries.splits_scaling import SPLIT_SQL
from tickwise.session import staged


def _windows(spark, sf, stride, hot=None):
    return wi.sliding_windows(
        frames(spark, sf), ["seq"], FRAME_ORDER, 50, stride, "label",
        {"c0": F.avg(F.get("kin", F.lit(0))), "c1": F.avg(F.get("kin", F.lit(1)))}, hot)


def _hot(spark, sf):
    return hot_keys(frames(spark, sf), ["seq"])


_WINDOW_ROWS = """,
wins AS (SELECT seq, win, max(label) AS y, avg(c0) AS c0, avg(c1) AS c1 FROM ticks GROUP BY 1, 2)"""


@query(
    "sliding_windows",
    f"""WITH {windows_sql(50, 10)}{_WINDOW_ROWS}
    SELECT seq, win AS "window", win * 10 AS start, y, {q6('c0')} AS c0, {q6('c1')} AS c1 FROM wins""",
)
def sliding(spark, sf):
    return _windows(spark, sf, 10).select("seq", "window", "start", "y", r6("c0").alias("c0"), r6("c1").alias("c1"))


@query(
    "windows_by_split",
    f"""WITH {windows_sql(50, 50)}{_WINDOW_ROWS}
    SELECT seq, win AS "window", y, {q6('c0')} AS c0, 0.0::DOUBLE AS c5,
           CASE WHEN md5(seq::VARCHAR) < '8' THEN 'train' ELSE 'test' END AS split FROM wins""",
)
def by_split(spark, sf):
    rows = frames(spark, sf)
    hot = hot_keys(rows, ["seq"])
    splits = rows.select("seq").distinct().withColumn(
        "split", F.when(F.md5(F.col("seq").cast("string")) < "8", "train").otherwise("test"))
    aggs = {"c0": F.avg(F.get("kin", F.lit(0))), "c5": F.max(F.get("kin", F.lit(5)))}
    out = wi.windows_by_split(rows, splits, ["seq"], FRAME_ORDER, 50, 50, "label", "kin", 6, aggs, hot, "split")
    return out.select("seq", "window", "y", r6("c0").alias("c0"), "c5", "split")


@query(
    "build_bags",
    f"WITH {windows_sql(50, 10)}{_WINDOW_ROWS} SELECT seq, max(y) AS bag_label, count(*) AS n_windows FROM wins GROUP BY 1",
)
def bags(spark, sf):
    return wi.build_bags(_windows(spark, sf, 10), ["seq"])


_TAIL = f"""{windows_sql(50, 10)}{_WINDOW_ROWS},
sized AS (
    SELECT *, CASE seq % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS dataset_id,
           max(y) OVER (PARTITION BY seq) AS bag_label, count(*) OVER (PARTITION BY seq) AS n FROM wins),
kept AS (
    SELECT *, CASE WHEN bag_label > 0.5 AND dataset_id = 'even' THEN greatest(1, round_even(0.3::DOUBLE * n, 0)::BIGINT)
                   WHEN bag_label > 0.5 THEN greatest(1, round_even(0.75::DOUBLE * n, 0)::BIGINT) ELSE n END AS k
    FROM sized)"""


def _tail(spark, sf):
    hot = _hot(spark, sf)
    w = _windows(spark, sf, 10, hot).withColumn("dataset_id", F.when(F.col("seq") % 2 == 0, "even").otherwise("odd"))
    return wi.bag_tail_filter(w, ["seq"], "window", "y", "dataset_id", {"even": 0.3, "odd": 0.75}, hot=hot)


@query("bag_tail_filter", f'WITH {_TAIL} SELECT dataset_id, seq, win AS "window", y FROM kept WHERE win >= n - k')
def tail(spark, sf):
    return _tail(spark, sf).select("dataset_id", "seq", "window", "y")


@query(
    "tail_filter_stats",
    f"""WITH {_TAIL}, per_bag AS (SELECT dataset_id, seq, max(n) AS n, max(k) AS k FROM kept GROUP BY 1, 2)
    SELECT dataset_id, count(*) FILTER (k < n) AS bags_filtered,
           {q6('coalesce(avg(n) FILTER (k < n), 0.0)')} AS avg_len_before,
           {q6('coalesce(avg(k) FILTER (k < n), 0.0)')} AS avg_len_after FROM per_bag GROUP BY 1""",
)
def tail_stats(spark, sf):
    s = wi.tail_filter_stats(_tail(spark, sf), ["seq"], ["dataset_id"])
    return s.withColumn("avg_len_before", r6("avg_len_before")).withColumn("avg_len_after", r6("avg_len_after"))


@query(
    "bag_attributes",
    f"""WITH {DESCRIPTORS_SQL}, given AS (SELECT seq, embedding AS v FROM descriptors WHERE idx = 0 AND label < 5),
    heads AS (SELECT seq, max(label % 2) AS bag_label, count(*) AS n_windows FROM descriptors GROUP BY 1)
    SELECT seq, bag_label::DOUBLE AS bag_label, n_windows, {q6('coalesce(list_sum(v), 0.0)')} AS total,
           64::BIGINT AS width, CASE WHEN seq % 2 = 1 THEN 1 ELSE 0 END AS use_null
    FROM heads LEFT JOIN given USING (seq)""",
)
def attributes(spark, sf):
    d = descriptors(spark, sf)
    heads = wi.build_bags(d.withColumn("y", F.col("label") % 2), ["seq"])
    given = d.where("idx = 0 AND label < 5").select("seq", F.col("embedding").alias("nl_emb"))
    flag = F.when(F.col("seq") % 2 == 1, 1).otherwise(0)
    out = wi.bag_attributes(heads, given, ["seq"], "nl_emb", 64, flag)
    return out.select(
        "seq", "bag_label", "n_windows", r6(F.aggregate("nl_emb", F.lit(0.0), lambda s, x: s + x)).alias("total"),
        F.size("nl_emb").cast("long").alias("width"), "use_null")


@query(
    "pad_bags",
    f"""WITH {windows_sql(50, 10)}{_WINDOW_ROWS},
    sized AS (SELECT seq, seq // 16 AS batch, count(*) AS n FROM wins GROUP BY 1),
    longest AS (SELECT batch, max(n) AS m FROM sized GROUP BY 1),
    slots AS (SELECT seq, batch, unnest(range(0, m)) AS win FROM sized JOIN longest USING (batch))
    SELECT seq, batch, win AS "window", CASE WHEN w.y IS NULL THEN 0 ELSE 1 END AS valid,
           {q6('coalesce(c0, 0.0)')} AS v0, {q6('coalesce(c1, 0.0)')} AS v1
    FROM slots LEFT JOIN wins w USING (seq, win)""",
)
def padded(spark, sf):
    hot = _hot(spark, sf)
    w = staged(_windows(spark, sf, 10, hot).select("seq", "window", "y", F.array("c0", "c1").alias("v")), "windows")
    heads = wi.build_bags(w, ["seq"]).withColumn("batch", F.floor(F.col("seq") / 16))
    out = wi.pad_bags(w, heads, ["seq"], "batch", "window", "v", 2, hot)
    return out.select(
        "seq", "batch", "window", "valid", r6(F.get("v", F.lit(0))).alias("v0"), r6(F.get("v", F.lit(1))).alias("v1"))


# --- pooling -------------------------------------------------------------------------------

def _weights(row: int, width: int = 64) -> list[float]:
    """Small fixed weights that both sides can write down."""
    return [((d * 7 + row * 3) % 11 - 5) / 10.0 for d in range(width)]


def _weights_sql(row: int, width: int = 64) -> str:
    return "[" + ", ".join(f"{w}::DOUBLE" for w in _weights(row, width)) + "]"


def _dot(row: int) -> str:
    return f"list_dot_product(embedding, {_weights_sql(row)})"


def _gate(v: int, u: int) -> str:
    return f"tanh({_dot(v)}) * (1 / (1 + exp(-{_dot(u)})))"


def _softmax_sql(logit: str) -> str:
    return f"""{DESCRIPTORS_SQL}, logits AS (SELECT *, {logit} AS l FROM descriptors),
    shifted AS (SELECT *, exp(l - max(l) OVER (PARTITION BY seq)) AS e FROM logits),
    attn AS (SELECT *, e / sum(e) OVER (PARTITION BY seq) AS a FROM shifted),
    parts AS (SELECT seq, a, unnest(range(0, 64)) AS dim, unnest(embedding) AS x FROM attn)
    SELECT 'z' AS kind, seq, dim AS idx, {q6('sum(a * x)')} AS value FROM parts GROUP BY seq, dim
    UNION ALL SELECT 'w', seq, idx, {q6('a')} FROM attn"""


def _both(pooled, weights):
    z = pooled.select("seq", F.posexplode("z").alias("dim", "z")).select(
        F.lit("z").alias("kind"), "seq", F.col("dim").cast("long").alias("idx"), r6("z").alias("value"))
    return z.unionByName(weights.select(
        F.lit("w").alias("kind"), "seq", F.col("idx").cast("long").alias("idx"), r6("weight").alias("value")))


@query("pool_gated_attention", "WITH " + _softmax_sql(f"1.5 * {_gate(0, 2)} - 0.5 * {_gate(1, 3)}"))
def gated(spark, sf):
    rows = descriptors(spark, sf)
    return _both(*pl.pool_gated_attention(
        rows, "seq", "idx", "embedding", 64,
        [_weights(0), _weights(1)], [_weights(2), _weights(3)], [1.5, -0.5], hot=hot_keys(rows, ["seq"])))


@query("pool_attention", "WITH " + _softmax_sql(f"{_dot(4)} + 0.25"))
def attention(spark, sf):
    rows = descriptors(spark, sf)
    return _both(*pl.pool_attention(rows, "seq", "idx", "embedding", _weights(4), 0.25, hot=hot_keys(rows, ["seq"])))


@query(
    "pool_max",
    f"""WITH {CELLS_SQL}, best AS (
        SELECT seq, dim, max(x) AS z, arg_max(idx, (x, -idx)) AS winner FROM cells GROUP BY 1, 2),
    wins AS (SELECT seq, winner AS idx, count(*) AS n FROM best GROUP BY 1, 2)
    SELECT 'z' AS kind, seq, dim AS idx, {q6('z')} AS value FROM best
    UNION ALL SELECT 'w', seq, idx, {q6('coalesce(n, 0) / 64.0::DOUBLE')} FROM descriptors LEFT JOIN wins USING (seq, idx)""",
)
def maximum(spark, sf):
    return _both(*pl.pool_max(descriptors(spark, sf), "seq", "idx", "embedding", 64))


@query(
    "pool_mean",
    f"""WITH {CELLS_SQL}
    SELECT 'z' AS kind, seq, dim AS idx, {q6('coalesce(avg(x) FILTER (label < 7), 0.0)')} AS value FROM cells GROUP BY 2, 3
    UNION ALL SELECT 'w', seq, idx, {q6('''CASE WHEN label < 7
        THEN 1.0::DOUBLE / greatest(1, count(*) FILTER (label < 7) OVER (PARTITION BY seq)) ELSE 0.0 END''')}
    FROM descriptors""",
)
def mean(spark, sf):
    return _both(*pl.pool_mean(descriptors(spark, sf), "seq", "idx", "embedding", 64, F.col("label") < 7))


@query(
    "null_token_route",
    f"""WITH {DESCRIPTORS_SQL} SELECT vec_id, 128::BIGINT AS width,
    {q6(f'CASE WHEN label % 2 = 1 THEN list_sum({_weights_sql(5)}) ELSE list_sum(embedding) END')} AS routed,
    {q6('embedding[1]')} AS own FROM descriptors""",
)
def null_token(spark, sf):
    routed = vec.route_instruction(F.col("embedding"), F.col("label") % 2 == 1, vec.vector(_weights(5)))
    rows = descriptors(spark, sf).withColumn("r", routed)
    joined = F.concat(vec.doubles(F.col("embedding")), F.col("r"))
    return rows.select(
        "vec_id", F.size(joined).cast("long").alias("width"),
        r6(F.aggregate("r", F.lit(0.0), lambda s, x: s + x)).alias("routed"), r6(F.get(joined, F.lit(0))).alias("own"))


@query(
    "film_modulate",
    f"""WITH {CELLS_SQL}, params AS (
        SELECT unnest(range(0, 64)) AS dim, unnest({_weights_sql(6)}) AS g, unnest({_weights_sql(7)}) AS b)
    SELECT vec_id, dim::INTEGER AS dim, {q6('(1 + g) * x + b')} AS z FROM cells JOIN params USING (dim)""",
)
def modulate(spark, sf):
    out = vec.film(F.col("embedding"), vec.vector(_weights(6)), vec.vector(_weights(7)))
    return descriptors(spark, sf).select("vec_id", F.posexplode(out).alias("dim", "z")).select(
        "vec_id", "dim", r6("z").alias("z"))


# --- scoring -------------------------------------------------------------------------------

@query(
    "score_bags",
    f"""WITH {CELLS_SQL}, pooled AS (SELECT seq, dim, avg(x) AS z, max(label % 2) AS y FROM cells GROUP BY 1, 2),
    params AS (SELECT unnest(range(0, 64)) AS dim, unnest({_weights_sql(8)}) AS w)
    SELECT seq, max(y) AS y, {q6('1 / (1 + exp(-(sum(w * z) - 0.1)))')} AS p FROM pooled JOIN params USING (dim) GROUP BY 1""",
)
def score(spark, sf):
    d = descriptors(spark, sf)
    bag = d.groupBy("seq").agg(
        F.array(*[F.avg(x) for x in vec.elements(F.col("embedding"), 64)]).alias("z"),
        F.max(F.col("label") % 2).alias("y"))
    return so.score_bags(bag, "z", so.linear_scorer(_weights(8), -0.1)).select("seq", "y", r6("p").alias("p"))


# Ridge with which plain gradient descent in SQL also comes to the optimum within rounding.
_RIDGE = 0.5
_TRAIN_SQL = f"""WITH RECURSIVE {windows_sql(10, 10)},
wins AS (
    SELECT seq * 1000000 + win // 4 AS bag, win, max(label) AS y, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2, avg(c3) AS c3
    FROM ticks GROUP BY seq, win),
bags AS (
    SELECT bag, max(y) AS bag_label, [{', '.join(f"{fn}(c{i}{', win' if fn == 'max_by' else ''})"
    for fn in ('avg', 'stddev_pop', 'max', 'max_by') for i in range(4))}] AS v FROM wins GROUP BY bag),
labelled AS (SELECT 'frames' AS dataset_id, bag AS sequence_name, bag_label AS label FROM bags),{SPLIT_SQL},
cells AS (SELECT bag, unnest(range(1, 17)) AS j, unnest(v) AS x FROM bags),
fitted AS (
    SELECT j, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std
    FROM cells JOIN assigned ON sequence_name = bag WHERE split = 'train' GROUP BY 1),
ready AS MATERIALIZED (
    SELECT bag, split, label AS y, list_append(list((x - mean) / std ORDER BY j), 1.0) AS x
    FROM cells JOIN fitted USING (j) JOIN assigned ON sequence_name = bag GROUP BY ALL),
train AS MATERIALIZED (SELECT x, y FROM ready WHERE split = 'train'),
fit AS (
    SELECT 0 AS step, [{', '.join(['0.0::DOUBLE'] * 17)}] AS w
    UNION ALL
    SELECT step + 1, list(w ORDER BY j) FROM (
        SELECT step, j, any_value(w[j]) - CASE WHEN j < 17 THEN 0.2 ELSE 2.0 END * (
            avg((1 / (1 + exp(-list_dot_product(w, x))) - y) * x[j])
            + CASE WHEN j < 17 THEN {_RIDGE} * any_value(w[j]) ELSE 0 END) AS w
        FROM (SELECT step, w, x, y, unnest(range(1, 18)) AS j FROM fit, train WHERE step < 400) GROUP BY step, j)
    GROUP BY step)"""


@query(
    "train_bag_classifier",
    f"""{_TRAIN_SQL}
    SELECT bag AS seq, split, y AS bag_label, {q6('1 / (1 + exp(-list_dot_product(w, x)))')} AS p
    FROM ready, fit WHERE step = 400""",
)
def train(spark, sf):
    """Bags of four short windows, so that both classes occur."""
    cut = wi.sliding_windows(
        frames(spark, sf), ["seq"], FRAME_ORDER, 10, 10, "label",
        {f"c{i}": F.avg(F.get("kin", F.lit(i))) for i in range(4)})
    bag = (F.col("seq") * 1_000_000 + F.floor(F.col("window") / 4)).alias("seq")
    windows = staged(cut.select(bag, "window", "y", F.array("c0", "c1", "c2", "c3").alias("v")), "windows")
    heads = wi.build_bags(windows, ["seq"]).withColumn("dataset_id", F.lit("frames"))
    features = so.bag_features(windows, ["seq"], "window", "v", 4).join(heads, "seq")
    splits = split_stratified(heads.select("dataset_id", "seq", "bag_label"), "dataset_id", "seq", "bag_label")
    ready = staged(features.join(splits.select("seq", "split"), "seq"), "bags")
    model = so.train_bag_classifier(ready.where("split = 'train'"), "features", "bag_label", l2=_RIDGE)
    return so.predict_bags(model, ready, "features").select("seq", "split", "bag_label", r6("p").alias("p"))


_LOSS_SQL = f"""{DESCRIPTORS_SQL}, logits AS (
        SELECT 'd' || (label % 3)::VARCHAR AS dataset_id, 8 * embedding[1] AS x, (label % 2)::DOUBLE AS y FROM descriptors),
    terms AS (
        SELECT dataset_id, x, y, y * 0.95::DOUBLE + (1 - y) * 0.05::DOUBLE AS s, 1 / (1 + exp(-x)) AS p FROM logits)"""


@query(
    "loss_metrics",
    f"""WITH {_LOSS_SQL}
    SELECT dataset_id, {q6('avg(-(2 * y * ln(p) + (1 - y) * ln(1 - p)))')} AS bce,
           {q6('avg(0.25 * power(1 - (p * s + (1 - p) * (1 - s)), 2) * -(2 * s * ln(p) + (1 - s) * ln(1 - p)))')} AS focal
    FROM terms GROUP BY 1""",
)
def losses(spark, sf):
    rows = descriptors(spark, sf).select(
        F.concat(F.lit("d"), (F.col("label") % 3).cast("string")).alias("dataset_id"),
        (F.get("embedding", F.lit(0)).cast("double") * 8).alias("x"), (F.col("label") % 2).alias("y"))
    out = so.loss_metrics(rows, "x", "y", ["dataset_id"], pos_weight=2.0, smoothing=0.05)
    return out.select("dataset_id", r6("bce").alias("bce"), r6("focal").alias("focal"))


@query(
    "encode_payloads",
    """SELECT page_id, octet_length(encode(html))::DOUBLE AS n_bytes,
    (length(html) - length(replace(html, '<', '')))::DOUBLE AS n_tags,
    (length(html) - length(replace(html, ' ', '')))::DOUBLE AS n_blanks,
    (length(html) - length(replace(html, chr(10), '')))::DOUBLE AS n_lines FROM pages""",
)
def payloads(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("data"))
    out = so.encode_payloads(rows, "data", so.byte_statistics)
    names = ["n_bytes", "n_tags", "n_blanks", "n_lines"]
    return out.select("page_id", *[F.get("cnn", F.lit(i)).alias(n) for i, n in enumerate(names)])
