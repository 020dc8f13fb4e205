"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.functions import scalars as sc
from tickwise.functions import vectors as vec
from tickwise.operators import features as ft
from tickwise.operators.scoring import jitter, mixup
from tickwise.queries import query
from tickwise.queries.common import CELLS_SQL, DESCRIPTORS_SQL, SCORES_SQL, descriptors, q6, r6, scores, table
from tickwise.schema import CANONICAL, SourceSpec, register_source

# Sources over the given tables, one per way of reading the gripper.
register_source(SourceSpec(
    "frames_scalar", ("arm",), "arm", "l_discount", "scalar", 0.05,
    columns={"ee_pos_x": "l_quantity", "ee_pos_y": "l_extendedprice", "ee_pos_z": "l_tax", "ee_rot_qx": "l_linenumber",
             "ee_rot_qy": "l_partkey", "ee_rot_qz": "l_suppkey", "ee_rot_qw": "absent"},
))
register_source(SourceSpec("vectors_first", ("arm",), "arm", "embedding", "first", 0.0))
register_source(SourceSpec("vectors_mean", ("arm",), "arm", "embedding", "mean", 0.0))


def _posed(spark, sf):
    at = [F.get(F.col("embedding"), F.lit(i)).cast("double") for i in range(7)]
    return descriptors(spark, sf).select(
        "vec_id", "embedding", *[c.alias(n) for c, n in zip(at, ft.pose_columns("arm"))]
    )


_CANONICAL_SQL = f"""WITH {DESCRIPTORS_SQL}
SELECT 'frames_scalar' AS dataset_id, l_orderkey AS id, l_quantity AS ee_pos_x, {q6('l_extendedprice')} AS ee_pos_y,
       l_tax AS ee_pos_z, l_linenumber::DOUBLE AS ee_rot_qx, l_partkey::DOUBLE AS ee_rot_qy,
       l_suppkey::DOUBLE AS ee_rot_qz, NULL::DOUBLE AS ee_rot_qw,
       CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS gripper_state FROM lineitem
""" + "".join(
    f"""UNION ALL SELECT '{name}', vec_id, {', '.join(q6(f'embedding[{i + 1}]') for i in range(7))},
       CASE WHEN {value} > 0.0 THEN 1.0 ELSE 0.0 END::DOUBLE FROM descriptors
""" for name, value in (("vectors_first", "embedding[1]"), ("vectors_mean", "list_avg(embedding)"))
)


@query("project_canonical", _CANONICAL_SQL)
def canonical(spark, sf):
    parts = [(table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey")), "frames_scalar")]
    posed = _posed(spark, sf).withColumnRenamed("vec_id", "id")
    parts += [(posed, "vectors_first"), (posed, "vectors_mean")]
    done = [ft.project_canonical(df, d, ["id"]).withColumn("dataset_id", F.lit(d)) for df, d in parts]
    return ft.union_datasets(done).select("dataset_id", "id", *[r6(c).alias(c) for c in CANONICAL])


_POSE_OUT = CANONICAL[:7]


@query(
    "pose_fields",
    f"WITH {DESCRIPTORS_SQL} SELECT vec_id, "
    + ", ".join(f"{q6(f'embedding[{i + 1}]')} AS {n}" for i, n in enumerate(_POSE_OUT)) + " FROM descriptors",
)
def pose(spark, sf):
    e = [F.get(F.col("embedding"), F.lit(i)).cast("double") for i in range(7)]
    position = F.struct(*[e[i].alias(a) for i, a in enumerate("xyz")])
    orientation = F.struct(*[e[i + 3].alias(a) for i, a in enumerate("xyzw")])
    rows = descriptors(spark, sf).select(
        "vec_id", F.struct(position.alias("position"), orientation.alias("orientation")).alias("pose"))
    return ft.pose_fields(rows, "pose", _POSE_OUT).select("vec_id", *[r6(c).alias(c) for c in _POSE_OUT])


@query(
    "numeric_coerce",
    "SELECT doc_id, try_cast(source AS DOUBLE) AS bad, try_cast(substr(source, 4) AS DOUBLE) AS good FROM documents",
)
def coerce(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", sc.to_number(F.col("source")).alias("bad"),
        sc.to_number(F.expr("substring(source, 4)")).alias("good"))


@query("missing_column", "SELECT doc_id, n_chars::DOUBLE AS present, NULL::DOUBLE AS absent FROM documents")
def missing(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", sc.column_or_missing(docs, "n_chars").alias("present"),
        sc.column_or_missing(docs, "no_such_column").alias("absent"))


@query("array_mean", f"WITH {DESCRIPTORS_SQL} SELECT vec_id, {q6('list_avg(embedding)')} AS mean FROM descriptors")
def mean_of_array(spark, sf):
    return descriptors(spark, sf).select("vec_id", r6(vec.array_mean(F.col("embedding"))).alias("mean"))


@query("array_first", f"WITH {DESCRIPTORS_SQL} SELECT vec_id, {q6('embedding[1]')} AS first FROM descriptors")
def first_of_array(spark, sf):
    return descriptors(spark, sf).select(
        "vec_id", r6(vec.array_first(F.col("embedding")).cast("double")).alias("first"))


@query(
    "binarize",
    f"WITH {DESCRIPTORS_SQL} SELECT vec_id, "
    + ", ".join(f"CASE WHEN embedding[1] > {t} THEN 1.0 ELSE 0.0 END::DOUBLE AS {d}"
                for d, t in (("reassemble", 0.025), ("droid", 0.5), ("fractal_rt1", 0.5))) + " FROM descriptors",
)
def binary(spark, sf):
    first = vec.array_first(F.col("embedding")).cast("double")
    return descriptors(spark, sf).select(
        "vec_id", *[sc.binarize_for(d, first).alias(d) for d in ("reassemble", "droid", "fractal_rt1")])


@query(
    "residual",
    """SELECT doc_id, coalesce(n_chars - try_cast(substr(source, 4) AS DOUBLE), 0.0) AS known,
    coalesce(n_chars - try_cast(source AS DOUBLE), 0.0) AS unknown FROM documents""",
)
def residuals(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", sc.residual(F.col("n_chars"), F.expr("substring(source, 4)")).alias("known"),
        sc.residual(F.col("n_chars"), F.col("source")).alias("unknown"))


@query(
    "first_valid_vector",
    f"""WITH {DESCRIPTORS_SQL}, firsts AS (
        SELECT seq, arg_min(embedding, vec_id) AS v FROM descriptors WHERE label % 3 <> 0 GROUP BY seq)
    SELECT vec_id, {q6('v[1]')} AS v0, {q6('v[64]')} AS v63 FROM descriptors LEFT JOIN firsts USING (seq)""",
)
def first_valid(spark, sf):
    rows = descriptors(spark, sf).withColumn(
        "v", F.when(F.col("label") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    firsts = ft.first_valid_vector(rows, "seq", ["vec_id"], "v", 64, "first")
    return rows.join(firsts, "seq", "left").select(
        "vec_id", r6(F.get("first", F.lit(0)).cast("double")).alias("v0"),
        r6(F.get("first", F.lit(63)).cast("double")).alias("v63"))


@query("drop_incomplete", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def incomplete(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return ft.drop_incomplete(joined, ["n_chars", "quality"]).select("doc_id", "quality")


def _damaged():
    """Vectors of three labels get one bad element appended."""
    bad = F.when(F.col("label") == 3, F.lit(float("inf"))).when(F.col("label") == 4, F.lit(float("nan")))
    v = F.col("embedding").cast("array<double>")
    return F.when(F.col("label").isin(3, 4, 5), F.concat(v, F.array(bad))).otherwise(v)


_DAMAGED_SQL = DESCRIPTORS_SQL + """,
damaged AS (SELECT vec_id, label, CASE WHEN label IN (3, 4, 5) THEN list_append(embedding,
    CASE label WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN 'nan'::DOUBLE END) ELSE embedding END AS v FROM descriptors)"""


@query(
    "drop_nonfinite",
    f"""WITH {_DAMAGED_SQL} SELECT vec_id, len(v)::BIGINT AS width FROM damaged
    WHERE len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = len(v)""",
)
def nonfinite(spark, sf):
    rows = descriptors(spark, sf).withColumn("v", _damaged())
    return ft.drop_nonfinite(rows, "v").select("vec_id", F.size("v").cast("long").alias("width"))


@query(
    "fit_width",
    f"""WITH {DESCRIPTORS_SQL} SELECT vec_id, 70::BIGINT AS wide, {q6('embedding[64]')} AS kept, 0.0::DOUBLE AS padded,
    10::BIGINT AS narrow, {q6('list_sum(embedding[1:10])')} AS clipped FROM descriptors""",
)
def widths(spark, sf):
    wide, narrow = vec.fit_width(F.col("embedding"), 70), vec.fit_width(F.col("embedding"), 10)
    return descriptors(spark, sf).select(
        "vec_id", F.size(wide).cast("long").alias("wide"), r6(F.get(wide, F.lit(63))).alias("kept"),
        F.get(wide, F.lit(69)).alias("padded"), F.size(narrow).cast("long").alias("narrow"),
        r6(F.aggregate(narrow, F.lit(0.0), lambda s, x: s + x)).alias("clipped"))


@query("detect_width", f"WITH {_DAMAGED_SQL} SELECT max(len(v))::INTEGER AS width FROM damaged")
def width(spark, sf):
    return ft.detect_width(descriptors(spark, sf).withColumn("v", _damaged()), "v")


@query("parse_sequence_name", "SELECT doc_id, source AS file, doc_id AS episode FROM documents")
def parse_name(spark, sf):
    named = table(spark, sf, "documents").withColumn(
        "name", F.concat(F.lit("droid_"), "source", F.lit("_ep"), F.col("doc_id").cast("string")))
    return named.select(
        "doc_id", sc.file_stem(F.col("name"), "droid_").alias("file"), sc.episode_id(F.col("name")).alias("episode"))


@query("safe_name", "SELECT page_id, translate(url, '/' || chr(92), '__') AS name FROM pages")
def safe(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.safe_name(F.col("url")).alias("name"))


@query("duration_seconds", "SELECT doc_id, round_even(n_chars / 50.0::DOUBLE, 1) AS seconds FROM documents")
def seconds(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.duration_seconds(F.col("n_chars"), 50).alias("seconds"))


@query("label_smooth", f"SELECT doc_id, {q6('toxic * (1 - 0.05::DOUBLE) + (1 - toxic) * 0.05::DOUBLE')} AS y FROM labels")
def smooth(spark, sf):
    return table(spark, sf, "labels").select("doc_id", r6(sc.label_smooth(F.col("toxic"), 0.05)).alias("y"))


@query(
    "alert_level",
    f"""WITH {SCORES_SQL} SELECT sequence_name,
    CASE WHEN p < 0.3 THEN 'safe' WHEN p < 0.6 THEN 'warn' ELSE 'alarm' END AS level,
    {q6("CASE WHEN p < 0.3 THEN 0.0::DOUBLE WHEN p < 0.6 THEN (p - 0.3) / 0.3 ELSE 1.0 END")} AS ramp FROM scores""",
)
def alerts(spark, sf):
    p = F.col("p")
    return scores(spark, sf).select(
        "sequence_name", sc.alert_level(p, 0.6).alias("level"), r6(sc.alert_ramp(p, 0.6)).alias("ramp"))


def _draw(kind: str) -> str:
    return (f"('0x' || substr(md5('42:{kind}' || vec_id::VARCHAR || ':' || dim::VARCHAR), 1, 8))::BIGINT "
            "/ 4294967296.0::DOUBLE")


@query(
    "jitter",
    f"""WITH {CELLS_SQL} SELECT vec_id, dim::INTEGER AS dim,
    {q6(f'x + 0.02 * sqrt(-2 * ln(1 - {_draw("u")})) * cos(2 * pi() * {_draw("v")})')} AS x FROM cells""",
)
def noise(spark, sf):
    rows = descriptors(spark, sf).withColumn("row_id", F.col("vec_id"))
    noisy = jitter(rows, "embedding", 0.02)
    return noisy.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", r6("x"))


@query(
    "mixup",
    f"""WITH {DESCRIPTORS_SQL}, placed AS (
        SELECT *, vec_id // 64 AS batch,
               row_number() OVER (PARTITION BY vec_id // 64 ORDER BY md5('42:' || vec_id::VARCHAR), vec_id) AS a,
               row_number() OVER (PARTITION BY vec_id // 64 ORDER BY md5('43:' || vec_id::VARCHAR), vec_id) AS b
        FROM descriptors)
    SELECT x.vec_id, x.batch, y.vec_id AS partner,
           {q6('0.3::DOUBLE * x.embedding[1] + (1 - 0.3::DOUBLE) * y.embedding[1]')} AS v0,
           {q6('0.3::DOUBLE * x.embedding[64] + (1 - 0.3::DOUBLE) * y.embedding[64]')} AS v63,
           {q6('0.3::DOUBLE * (x.label % 2) + (1 - 0.3::DOUBLE) * (y.label % 2)')} AS y
    FROM placed x JOIN placed y ON x.batch = y.batch AND x.a = y.b""",
)
def mixed(spark, sf):
    rows = descriptors(spark, sf).select(
        "vec_id", F.floor(F.col("vec_id") / 64).alias("batch"), "embedding", (F.col("label") % 2).alias("y"))
    lam = rows.select("batch").distinct().withColumn("lam", F.lit(0.3))
    out = mixup(rows, "vec_id", "batch", "embedding", "y", lam)
    return out.select(
        "vec_id", "batch", "partner", r6(F.get("embedding", F.lit(0))).alias("v0"),
        r6(F.get("embedding", F.lit(63))).alias("v63"), r6("y").alias("y"))


@query("sigmoid_score", f"WITH {DESCRIPTORS_SQL} SELECT vec_id, {q6('1 / (1 + exp(-embedding[1]))')} AS p FROM descriptors")
def logistic(spark, sf):
    return descriptors(spark, sf).select(
        "vec_id", r6(sc.sigmoid(vec.array_first(F.col("embedding")).cast("double"))).alias("p"))


