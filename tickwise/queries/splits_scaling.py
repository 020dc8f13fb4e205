"""Splits, class balance, normalisation and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwise.operators import scaling as sl
from tickwise.operators import splits as sp
from tickwise.operators import windows as wi
from tickwise.operators.ordered import hot_keys
from tickwise.queries import query
from tickwise.queries.catalog_joins import _SIZES_SQL
from tickwise.queries.common import (
    CELLS_SQL, FRAME_ORDER, LABELLED_SQL, POOLS_SQL, descriptors, frames, labelled_documents, order_pools, q6, r6,
    table, windows_sql,
)


def _share(total: str, a: str, b: str) -> str:
    """Part of a total for the first class by largest remainder."""
    x, y = f"({total}) * {a} / ({a} + {b})", f"({total}) * {b} / ({a} + {b})"
    return (f"(floor({x}) + CASE WHEN ({total}) - floor({x}) - floor({y}) > 0 AND {x} - floor({x}) >= {y} - floor({y}) "
            f"THEN 1 ELSE 0 END)::BIGINT")


# Split of the CTE ``labelled`` (dataset_id, sequence_name, label).
SPLIT_SQL = f"""
counts AS (SELECT dataset_id, count(*) AS n, sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0 FROM labelled GROUP BY 1),
c1 AS (SELECT *, ceil((1.0::DOUBLE - 0.7::DOUBLE) * n)::BIGINT AS rest FROM counts),
c2 AS (SELECT *, {_share('n - rest', 'n0', 'n1')} AS tr0 FROM c1),
c3 AS (SELECT *, n - rest - tr0 AS tr1, n0 - tr0 AS r0 FROM c2),
c4 AS (SELECT *, n1 - tr1 AS r1, floor(0.15::DOUBLE / (1.0::DOUBLE - 0.7::DOUBLE) * rest)::BIGINT AS nval FROM c3),
c5 AS (
    SELECT *, CASE WHEN r0 + r1 = 0 THEN 0 ELSE {_share('nval', 'r0', 'r1')} END AS va0,
           least(greatest(1, floor(0.7::DOUBLE * n)::BIGINT), n - 2) AS ptr FROM c4),
sizes AS (SELECT *, nval - va0 AS va1, least(greatest(1, floor(0.15::DOUBLE * n)::BIGINT), n - ptr - 1) AS pva FROM c5),
r AS (
    SELECT l.*, s.* EXCLUDE (dataset_id), md5('42:' || sequence_name::VARCHAR) AS k,
           row_number() OVER (PARTITION BY dataset_id, label ORDER BY md5('42:' || sequence_name::VARCHAR), sequence_name) - 1 AS rc,
           row_number() OVER (PARTITION BY dataset_id ORDER BY sequence_name) - 1 AS rn
    FROM labelled l JOIN sizes s USING (dataset_id)),
b AS (SELECT *, rc >= CASE WHEN label = 1 THEN tr1 ELSE tr0 END AS in_rest,
             rc - CASE WHEN label = 1 THEN tr1 ELSE tr0 END AS beyond FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, in_rest ORDER BY k, sequence_name) - 1 AS rr FROM b),
assigned AS (
    SELECT dataset_id, sequence_name, label,
        CASE WHEN n < 3 THEN 'train'
             WHEN least(n0, n1) < 2 THEN CASE WHEN rn < ptr THEN 'train' WHEN rn < ptr + pva THEN 'val' ELSE 'test' END
             WHEN NOT in_rest THEN 'train'
             WHEN least(r0, r1) < 2 THEN CASE WHEN rr < nval THEN 'val' ELSE 'test' END
             WHEN beyond < CASE WHEN label = 1 THEN va1 ELSE va0 END THEN 'val' ELSE 'test' END AS split
    FROM f)"""
_STRATIFIED_SQL = f"{LABELLED_SQL},{SPLIT_SQL}"


@query("split_stratified", f"WITH {_STRATIFIED_SQL} SELECT * FROM assigned")
def stratified(spark, sf):
    return sp.split_stratified(labelled_documents(spark, sf), "dataset_id", "sequence_name", "label")


@query(
    "split_zeroshot",
    f"""WITH {POOLS_SQL}, r AS (
        SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sequence_name) - 1 AS i,
               count(*) OVER (PARTITION BY dataset_id) AS n FROM pools)
    SELECT dataset_id, sequence_name, label,
           CASE WHEN dataset_id IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'test'
                WHEN n < 2 OR i < n - greatest(1, floor(0.15::DOUBLE * n)::BIGINT) THEN 'train' ELSE 'val' END AS split
    FROM r""",
)
def zeroshot(spark, sf):
    return sp.split_zeroshot(
        order_pools(spark, sf), "dataset_id", "sequence_name", ["1-URGENT", "2-HIGH", "5-LOW"],
        ["3-MEDIUM", "4-NOT SPECIFIED"])


@query(
    "split_pools_proportional",
    f"WITH {_SIZES_SQL} SELECT dataset_id, sequence_name, label, split FROM assigned WHERE split IS NOT NULL",
)
def proportional(spark, sf):
    return sp.split_pools_proportional(order_pools(spark, sf), "dataset_id", "sequence_name", "label")


@query(
    "split_report",
    f"""WITH {_STRATIFIED_SQL} SELECT dataset_id, split, count(*) AS n, {q6('avg(label)')} AS pos_ratio
    FROM assigned GROUP BY 1, 2""",
)
def report(spark, sf):
    assigned = sp.split_stratified(labelled_documents(spark, sf), "dataset_id", "sequence_name", "label")
    return sp.split_report(assigned, "dataset_id", "label").withColumn("pos_ratio", r6("pos_ratio"))


@query(
    "class_weights",
    f"""SELECT doc_id, quality, {q6('0.5::DOUBLE / greatest(1, count(*) OVER (PARTITION BY quality))')} AS weight
    FROM labels""",
)
def weights(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    return sp.class_weights(rows, "quality").withColumn("weight", r6("weight"))


def _uniform(prefix: str) -> str:
    return f"('0x' || substr(md5('42:{prefix}' || draw::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "weighted_resample",
    f"""WITH base AS (
        SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) - 1 AS pos
        FROM labels),
    n AS (SELECT count(*) AS n, sum(quality)::BIGINT AS n1, sum(1 - quality)::BIGINT AS n0 FROM labels),
    d AS (SELECT unnest(range(0, n)) AS draw, n1, n0 FROM n),
    c AS (SELECT *, CASE WHEN n1 = 0 THEN 0 WHEN n0 = 0 THEN 1 WHEN {_uniform('c')} < 0.5 THEN 0 ELSE 1 END AS cls FROM d),
    p AS (SELECT *, floor({_uniform('i')} * CASE WHEN cls = 1 THEN n1 ELSE n0 END)::BIGINT AS pos FROM c)
    SELECT draw, doc_id, base.quality FROM p JOIN base ON base.quality = p.cls AND base.pos = p.pos""",
)
def resample(spark, sf):
    return sp.weighted_resample(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(
    "pos_weight",
    f"""SELECT sum(toxic)::BIGINT AS n_pos, sum(1 - toxic)::BIGINT AS n_neg,
    {q6('sum(1 - toxic) / greatest(1, sum(toxic))')} AS pos_weight FROM labels""",
)
def positive_weight(spark, sf):
    return sp.pos_weight(table(spark, sf, "labels"), "toxic").withColumn("pos_weight", r6("pos_weight"))


# --- normalisation -------------------------------------------------------------------------

_SCALER_SQL = f"""WITH {windows_sql(50, 25)}, cells AS (
    SELECT 0 AS channel, c0 AS x FROM ticks UNION ALL SELECT 1, c1 FROM ticks
    UNION ALL SELECT 2, c2 FROM ticks UNION ALL SELECT 3, c3 FROM ticks UNION ALL SELECT 4, 0.0 FROM ticks)
SELECT channel, {q6('avg(x)')} AS mean, {q6('CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END')} AS std
FROM cells GROUP BY 1"""


def _fitted(spark, sf):
    return wi.clean_vectors(frames(spark, sf), "kin", 5)


def _rounded(scaler):
    return scaler.select("channel", r6("mean").alias("mean"), r6("std").alias("std"))


@query("fit_scaler", _SCALER_SQL)
def scaler(spark, sf):
    hot = hot_keys(frames(spark, sf), ["seq"])
    return _rounded(sl.fit_scaler(
        wi.window_ticks(_fitted(spark, sf), ["seq"], FRAME_ORDER, 50, 25, ["kin"], hot=hot), "kin", 5))


@query("fit_scaler_sumsq", _SCALER_SQL)
def scaler_sums(spark, sf):
    hot = hot_keys(frames(spark, sf), ["seq"])
    covered = wi.coverage(_fitted(spark, sf), ["seq"], FRAME_ORDER, 50, 25, hot=hot)
    return _rounded(sl.fit_scaler_sumsq(covered, "kin", "n_windows", 5))


@query(
    "apply_scaler",
    f"""WITH {CELLS_SQL}, fit AS (
        SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std
        FROM cells GROUP BY 1)
    SELECT vec_id, dim::INTEGER AS dim, {q6('(x - mean) / std')} AS z FROM cells JOIN fit USING (dim)""",
)
def standardised(spark, sf):
    d = descriptors(spark, sf)
    out = sl.apply_scaler(d, sl.fit_scaler(d, "embedding", 64), "embedding", "z")
    return out.select("vec_id", F.posexplode("z").alias("dim", "z")).select("vec_id", "dim", r6("z").alias("z"))


def _centred(spark, sf):
    d = descriptors(spark, sf)
    return sl.apply_scaler(d, sl.fit_scaler(d, "embedding", 64), "embedding", "v")


def _components_sql(count: int, squarings: int = 16) -> str:
    """Components by repeated squaring of the covariance, each taken out before the next.

    A high power of the matrix is the projector onto its leading vector; the column with the
    largest diagonal is that vector with a positive largest loading.
    """
    ctes = [f"""{CELLS_SQL},
    fit AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std
            FROM cells GROUP BY 1),
    z AS MATERIALIZED (SELECT vec_id, dim, (x - mean) / std AS x FROM cells JOIN fit USING (dim)),
    m0 AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, avg(a.x * b.x) AS v FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2)"""]
    for c in range(count):
        ctes.append(f"""
    p{c} AS (
        SELECT 0 AS step, i, j, v FROM m{c}
        UNION ALL
        SELECT step + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
            SELECT a.step, a.i, b.j, sum(a.v * b.v) AS v FROM p{c} a JOIN p{c} b ON a.j = b.i
            WHERE a.step < {squarings} GROUP BY a.step, a.i, b.j)),
    top{c} AS (SELECT j, sqrt(v) AS norm FROM p{c} WHERE step = {squarings} AND i = j ORDER BY v DESC, j LIMIT 1),
    v{c} AS MATERIALIZED (
        SELECT {c} AS component, p.i, p.v / norm AS x FROM p{c} p JOIN top{c} USING (j) WHERE step = {squarings}),
    e{c} AS MATERIALIZED (
        SELECT sum(a.x * m.v * b.x) AS value FROM m{c} m JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j),
    m{c + 1} AS MATERIALIZED (
        SELECT m.i, m.j, m.v - value * a.x * b.x AS v FROM m{c} m JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j, e{c})""")
    ctes.append("\n    components AS (" + " UNION ALL ".join(
        f"SELECT component, i, x, value FROM v{c}, e{c}" for c in range(count)) + ")")
    return "WITH RECURSIVE " + ",".join(ctes)


@query(
    "pca_fit",
    f"""{_components_sql(8)}
    SELECT component, i::INTEGER AS channel, {q6('x')} AS loading,
           {q6('value / (SELECT sum(v) FROM m0 WHERE i = j)')} AS explained FROM components""",
)
def components(spark, sf):
    loadings, ratios = sl.pca_fit(_centred(spark, sf), "v", 8)
    return sl.pca_table(loadings, ratios, spark).select(
        "component", "channel", r6("loading").alias("loading"), r6("explained").alias("explained"))


@query(
    "pca_apply",
    f"""{_components_sql(8)}
    SELECT vec_id, component, {q6('sum(z.x * c.x)')} AS z FROM z JOIN components c ON c.i = z.dim GROUP BY 1, 2""",
)
def projected(spark, sf):
    rows = _centred(spark, sf)
    loadings, _ = sl.pca_fit(rows, "v", 8)
    return sl.pca_apply(rows, loadings, "v", "z").select("vec_id", F.posexplode("z").alias("component", "z")).select(
        "vec_id", "component", r6("z").alias("z"))
