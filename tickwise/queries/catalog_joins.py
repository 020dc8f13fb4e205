"""Scans, sources, sinks, joins and set operations."""

from __future__ import annotations


from pyspark.sql import functions as F

from tickwise.operators.align import sparse_pivot, time_chunks
from tickwise.operators.features import union_datasets
from tickwise.operators.metrics import accuracy, auc
from tickwise.operators.scaling import fit_scaler_sumsq, scaler_table
from tickwise.operators.splits import split_pools_proportional
from tickwise.operators.traces import interleave, topk_scores
from tickwise.queries import query
from tickwise.queries.common import (
    CELLS_SQL, DATASET_OF_USER_SQL, DESCRIPTORS_SQL, FRAMES_SQL, HOUR_US, POOLS_SQL, SAMPLES_SQL, SCORES_SQL, TOPICS,
    dataset_of_user, descriptors, frames, order_pools, q6, r6, samples, scores, table,
)
from tickwise.session import scratch_dir
from tickwise.sources import catalog as cat
from tickwise.sources.files import episode_file_offset, episode_index
from tickwise.sources.tables import (
    commit_features, committed_features,
    feature_table_index, feature_table_write, incremental_todo, pools_read, pools_write, run_report,
)


@query("scan_dataset", "SELECT doc_id AS sequence_name FROM documents WHERE lang = 'en'")
def scan_dataset(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "sequence_name")
    return cat.scan_dataset(docs, "lang", "en", "sequence_name")


@query(
    "scan_metadata_eq",
    f"WITH {SAMPLES_SQL} SELECT DISTINCT sequence_name FROM samples WHERE json_extract_string(props, '$.k') = '42'",
)
def scan_metadata_eq(spark, sf):
    return cat.scan_metadata_eq(samples(spark, sf), "sequence_name", {"k": 42}, "props")


@query(
    "scan_topic_value",
    f"""WITH {SAMPLES_SQL}
    SELECT DISTINCT {DATASET_OF_USER_SQL} AS dataset_id, CASE WHEN value > 100 THEN 'failure' ELSE 'success' END AS outcome,
           sequence_name FROM samples WHERE topic = 'error'""",
)
def scan_topic_value(spark, sf):
    rows = samples(spark, sf).withColumn("dataset_id", dataset_of_user())
    catalog = rows.select("dataset_id", "sequence_name").distinct()
    outcomes = {"failure": F.col("value") > 100, "success": F.col("value") <= 100}
    return cat.topic_value_pools(catalog, rows, "sequence_name", "dataset_id", "topic", "error", outcomes)


@query(
    "scan_topics_available",
    f"WITH {SAMPLES_SQL} SELECT DISTINCT sequence_name, topic FROM samples WHERE topic IN ('click', 'purchase')",
)
def scan_topics_available(spark, sf):
    return cat.scan_topics_available(samples(spark, sf), "sequence_name", "topic", ["click", "purchase", "absent"])


@query(
    "sparse_pivot",
    f"WITH {SAMPLES_SQL} SELECT sequence_name, t, "
    + ", ".join(f"max(CASE WHEN topic = '{t}' THEN value END) AS {t}" for t in TOPICS)
    + " FROM samples GROUP BY sequence_name, t",
)
def sparse(spark, sf):
    return sparse_pivot(samples(spark, sf), "sequence_name", "t", "topic", "value", {t: t for t in TOPICS})


@query(
    "time_chunks",
    f"""WITH {SAMPLES_SQL}, start AS (SELECT sequence_name, min(t) AS t0 FROM samples GROUP BY 1)
    SELECT sequence_name, (t - t0) // {5 * HOUR_US} AS chunk, count(*) AS n, {q6('sum(value)')} AS total
    FROM samples JOIN start USING (sequence_name) GROUP BY 1, 2""",
)
def chunks(spark, sf):
    cut = time_chunks(samples(spark, sf), "sequence_name", "t", 5 * HOUR_US)
    return cut.groupBy("sequence_name", "chunk").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "feature_table_write",
    f"""WITH {DESCRIPTORS_SQL} SELECT vec_id, 'd' || (label % 3)::VARCHAR AS dataset_id, len(embedding)::BIGINT AS width,
    {q6('list_sum(embedding)')} AS total FROM descriptors""",
)
def table_write(spark, sf):
    rows = descriptors(spark, sf).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("label") % 3).cast("string")))
    path = scratch_dir(spark, "features")
    feature_table_write(rows, path, "dataset_id", "overwrite")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(path).select(
        "vec_id", "dataset_id", F.size("embedding").cast("long").alias("width"), r6(total).alias("total")
    )


@query(
    "incremental_build",
    """SELECT doc_id, lang AS dataset_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS run
    FROM documents""",
)
def incremental(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset_id"))
    path = scratch_dir(spark, "incremental")
    first = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    schema = "doc_id long, dataset_id string, run int"
    commit_features(first, path, "dataset_id", "1")
    todo = incremental_todo(docs, committed_features(spark, path, schema), ["dataset_id", "doc_id"])
    commit_features(todo, path, "dataset_id", "2")
    # Asked for once more, a run that is there changes nothing.
    commit_features(docs, path, "dataset_id", "1")
    return committed_features(spark, path, schema).select("doc_id", "dataset_id", "run")


@query(
    "feature_table_index",
    "SELECT lang AS dataset_id, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
)
def table_index(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("lang").alias("dataset_id"))
    root, other = scratch_dir(spark, "index"), scratch_dir(spark, "index-override")
    feature_table_write(docs.where("dataset_id <> 'fr'"), root, "dataset_id")
    docs.where("dataset_id = 'fr'").drop("dataset_id").write.parquet(other)
    rows, _ = feature_table_index(
        spark, root, ["en", "de", "es", "fr", "absent"], "dataset_id", {"fr": other}, "doc_id long, n_chars long"
    )
    return rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("episode_index", "SELECT DISTINCT source AS file, doc_id AS episode FROM documents")
def index_of_episodes(spark, sf):
    return episode_index(table(spark, sf, "documents"), "source", "doc_id")


FILE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"]


@query(
    "episode_file_offset",
    f"""WITH placed AS (
        SELECT l_returnflag || l_linestatus AS file, l_suppkey AS episode,
               row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY {', '.join(FILE_ORDER)}) - 1 AS i,
               count(*) OVER (PARTITION BY l_returnflag || l_linestatus) AS file_rows FROM lineitem)
    SELECT file, episode, min(i) AS start, max(file_rows) AS file_rows,
           round_even(min(i) * (max(file_rows) * 17 // 10) / max(file_rows), 0)::BIGINT AS other_start
    FROM placed GROUP BY 1, 2""",
)
def file_offset(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("file"), F.col("l_suppkey").alias("episode"), *FILE_ORDER
    )
    other = rows.groupBy("file").agg(F.expr("count(1) * 17 div 10").alias("other_rows"))
    return episode_file_offset(rows, "file", "episode", FILE_ORDER, other, "other_rows")


@query(
    "pools_write",
    f"""WITH {POOLS_SQL} SELECT dataset_id, CASE WHEN label = 1 THEN 'failure' ELSE 'success' END AS outcome,
    sequence_name::VARCHAR AS sequence_name FROM pools""",
)
def pools_json(spark, sf):
    pools = order_pools(spark, sf).select(
        "dataset_id", F.when(F.col("label") == 1, "failure").otherwise("success").alias("outcome"),
        F.col("sequence_name").cast("string").alias("sequence_name"),
    )
    path = scratch_dir(spark, "pools")
    pools_write(pools, path, "2024-01-01T00:00:00Z")
    return pools_read(spark, path).drop("generated_at")


@query(
    "run_report",
    f"""WITH {SCORES_SQL}, pairs AS (
        SELECT a.dataset_id, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS auc
        FROM scores a JOIN scores b ON a.dataset_id = b.dataset_id AND a.y = 1 AND b.y = 0 GROUP BY 1)
    SELECT dataset_id, count(*) AS sequences, count(*) FILTER (split = 'val') AS val,
           count(*) FILTER (split = 'test') AS test,
           {q6("avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy,
           {q6("max(auc)")} AS auc, '{{"seed":"42","stride":"50"}}' AS config
    FROM scores JOIN pairs USING (dataset_id) GROUP BY 1""",
)
def report(spark, sf):
    s = scores(spark, sf)
    counts = s.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.count_if(F.col("split") == "val").alias("val"),
        F.count_if(F.col("split") == "test").alias("test"),
    )
    metrics = accuracy(s, ["dataset_id"], "p", "y", 0.5).join(auc(s, ["dataset_id"], "p", "y"), "dataset_id")
    path = scratch_dir(spark, "report")
    run_report(counts, metrics, ["dataset_id"], {"stride": "50", "seed": "42"}, path)
    schema = "dataset_id string, sequences long, val long, test long, accuracy double, auc double, config string"
    back = spark.read.schema(schema).json(path)
    return back.withColumn("accuracy", r6("accuracy")).withColumn("auc", r6("auc"))


@query(
    "scaler_table",
    f"""WITH {CELLS_SQL}, {FRAMES_SQL}, all_cells AS (
        SELECT 'cnn' AS stream, dim AS channel, x FROM cells
        UNION ALL SELECT 'kin', 0, c0 FROM frames UNION ALL SELECT 'kin', 1, c1 FROM frames
        UNION ALL SELECT 'kin', 2, c2 FROM frames UNION ALL SELECT 'kin', 3, c3 FROM frames)
    SELECT stream, channel::INTEGER AS channel, {q6('avg(x)')} AS mean,
           {q6('CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END')} AS std
    FROM all_cells GROUP BY 1, 2""",
)
def scalers(spark, sf):
    both = scaler_table([
        ("kin", fit_scaler_sumsq(frames(spark, sf), "kin", width=4)),
        ("cnn", fit_scaler_sumsq(descriptors(spark, sf), "embedding", width=64)),
    ])
    path = scratch_dir(spark, "scaler")
    both.write.parquet(path)
    return spark.read.parquet(path).select("stream", "channel", r6("mean").alias("mean"), r6("std").alias("std"))


# --- joins, set operations, sorts, limits --------------------------------------------------

@query("pool_label_join", "SELECT doc_id, toxic AS label FROM documents LEFT JOIN labels USING (doc_id)")
def label_join(spark, sf):
    return cat.pool_label_join(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "toxic")


@query(
    "pool_intersect",
    """WITH kept AS (
        SELECT source AS dataset_id, doc_id AS sequence_name, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS label
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT * FROM kept WHERE dataset_id IN (
        SELECT dataset_id FROM kept GROUP BY 1 HAVING sum(label) > 0 AND sum(1 - label) > 0)""",
)
def intersect(spark, sf):
    pools = table(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("sequence_name"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("label"),
    )
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("sequence_name"))
    cached = pools.select("dataset_id", "sequence_name").join(labelled, "sequence_name", "left_semi")
    return cat.pool_intersect(cached, pools, "dataset_id", "sequence_name", "label")


_SIZES_SQL = POOLS_SQL + """,
counts AS (
    SELECT dataset_id, sum(1 - label)::BIGINT AS n_s, sum(label)::BIGINT AS n_f FROM pools GROUP BY 1
    HAVING sum(1 - label) > 0 AND sum(label) > 0),
priors AS (SELECT *, n_s::DOUBLE / (n_s + n_f) AS ps FROM counts),
totals AS (
    SELECT *, floor(least(n_s / greatest(0.7::DOUBLE * 0.65::DOUBLE + 0.3::DOUBLE * ps, 1e-9::DOUBLE),
                          n_f / greatest(0.7::DOUBLE * (1 - 0.65::DOUBLE) + 0.3::DOUBLE * (1 - ps), 1e-9::DOUBLE))) AS t
    FROM priors),
raw AS (
    SELECT *, round_even(0.7::DOUBLE * 0.65::DOUBLE * t, 0)::BIGINT AS ts,
           round_even(0.7::DOUBLE * (1 - 0.65::DOUBLE) * t, 0)::BIGINT AS tf,
           round_even(0.15::DOUBLE * ps * t, 0)::BIGINT AS vs, round_even(0.15::DOUBLE * (1 - ps) * t, 0)::BIGINT AS vf
    FROM totals),
sizes AS (
    SELECT *, greatest(0, least(ts, n_s - 2 * vs)) AS tr_s, greatest(0, least(tf, n_f - 2 * vf)) AS tr_f FROM raw),
ranked AS (
    SELECT p.*, row_number() OVER (PARTITION BY dataset_id, label ORDER BY md5('42:' || sequence_name::VARCHAR), sequence_name) AS r,
           CASE WHEN label = 1 THEN vf ELSE vs END AS nv, CASE WHEN label = 1 THEN tr_f ELSE tr_s END AS nt
    FROM pools p JOIN sizes USING (dataset_id)),
assigned AS (
    SELECT dataset_id, sequence_name, label,
           CASE WHEN r <= nv THEN 'val' WHEN r <= 2 * nv THEN 'test' WHEN r <= 2 * nv + nt THEN 'train' END AS split
    FROM ranked)"""


@query("heldout_anti", f"WITH {_SIZES_SQL} SELECT dataset_id, sequence_name, label FROM assigned WHERE split IS NULL")
def heldout(spark, sf):
    pools = order_pools(spark, sf)
    used = split_pools_proportional(pools, "dataset_id", "sequence_name", "label")
    return cat.heldout_anti(pools, used, ["dataset_id", "sequence_name"])


@query(
    "renderable_semi",
    "SELECT source AS file, doc_id AS episode, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def renderable(spark, sf):
    docs = table(spark, sf, "documents")
    index = episode_index(docs.join(table(spark, sf, "labels"), "doc_id"), "source", "doc_id")
    seqs = docs.select(F.col("source").alias("file"), F.col("doc_id").alias("episode"), "n_chars")
    return cat.renderable_semi(seqs, index, ["file", "episode"])


@query(
    "union_datasets",
    """SELECT 'documents' AS dataset_id, doc_id AS id, length(text)::BIGINT AS size, lang FROM documents
    UNION ALL SELECT 'pages', page_id, length(html)::BIGINT, NULL FROM pages
    UNION ALL SELECT 'benchmark', item_id, length(text)::BIGINT, NULL FROM benchmark""",
)
def union_all(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("dataset_id"), F.col("doc_id").alias("id"),
        F.length("text").cast("long").alias("size"), "lang")
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("dataset_id"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    items = table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("dataset_id"), F.col("item_id").alias("id"),
        F.length("text").cast("long").alias("size"))
    return union_datasets([docs, pages, items])


@query(
    "dataset_list_union",
    """WITH tagged AS (SELECT lang AS dataset_id, 1 AS tr, 0 AS te FROM documents
                       UNION ALL SELECT split_part(url, '/', 4), 0, 1 FROM pages)
    SELECT dataset_id, max(tr) AS in_train, max(te) AS in_test FROM tagged GROUP BY 1""",
)
def list_union(spark, sf):
    train = table(spark, sf, "documents").select(F.col("lang").alias("dataset_id"))
    test = table(spark, sf, "pages").select(F.split_part(F.col("url"), F.lit("/"), F.lit(4)).alias("dataset_id"))
    return cat.dataset_union(train, test, "dataset_id")


@query("pools_distinct_sorted", "SELECT DISTINCT user_id AS sequence_name FROM events ORDER BY 1")
def distinct_sorted(spark, sf):
    return cat.pools_distinct_sorted(samples(spark, sf), "sequence_name")


@query(
    "cap_per_dataset",
    """SELECT lang AS dataset_id, doc_id AS sequence_name FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3""",
)
def capped(spark, sf):
    names = table(spark, sf, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("sequence_name"))
    return cat.cap_per_dataset(names, "dataset_id", "sequence_name", 3)


_TOP_SQL = SCORES_SQL + """,
fails AS (SELECT *, row_number() OVER (ORDER BY p DESC, sequence_name) AS rank FROM scores WHERE y = 1),
oks AS (SELECT *, row_number() OVER (ORDER BY p, sequence_name) AS rank FROM scores WHERE y = 0)"""


@query(
    "topk_scores",
    f"""WITH {_TOP_SQL} SELECT sequence_name, y, {q6('p')} AS p, rank FROM fails WHERE rank <= 20
    UNION ALL SELECT sequence_name, y, {q6('p')}, rank FROM oks WHERE rank <= 20""",
)
def topk(spark, sf):
    s = scores(spark, sf).select("sequence_name", "y", "p")
    return topk_scores(s, "sequence_name", "y", "p", 20, 20).withColumn("p", r6("p"))


@query(
    "interleave",
    f"""WITH {_TOP_SQL} SELECT sequence_name, y, (rank - 1) * 2 + 1 AS slot FROM fails WHERE rank <= 2
    UNION ALL SELECT sequence_name, y, (rank - 1) * 2 + 2 FROM oks WHERE rank <= 2""",
)
def interleaved(spark, sf):
    s = scores(spark, sf).select("sequence_name", "y", "p")
    return interleave(topk_scores(s, "sequence_name", "y", "p", 2, 2), "y").select("sequence_name", "y", "slot")
