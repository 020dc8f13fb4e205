"""Bindings of the given tables to episodes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.align import micros

HOUR_US = 3_600_000_000
TOPICS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, because float sums depend on order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q6(expr: str) -> str:
    """The same in SQL; adding zero turns a negative zero into a plain one."""
    return f"(round({expr}, 6) + 0.0)"


# --- events: samples of several topics per user -------------------------------------------

def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_name, topic, t in microseconds, value, props)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sequence_name"),
        F.col("event_type").alias("topic"),
        micros(F.col("ts")).alias("t"),
        "value",
        "props",
    )


SAMPLES_SQL = """samples AS (
    SELECT user_id AS sequence_name, event_type AS topic, epoch_us(ts) AS t, value, props FROM events)"""


def dataset_of_user() -> Column:
    """Three datasets of users."""
    return F.concat(F.lit("ds"), (F.col("sequence_name") % 3).cast("string"))


DATASET_OF_USER_SQL = "'ds' || (sequence_name % 3)::VARCHAR"


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a scored window of its user: (sequence_name, t, score in [0, 1))."""
    return samples(spark, sf_dir).select(
        "sequence_name", "t", (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score")
    )


SCORED_SQL = """scored AS (
    SELECT user_id AS sequence_name, epoch_us(ts) AS t, value / (value + 50.0) AS score,
           row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n,
           count(*) OVER (PARTITION BY user_id) AS m
    FROM events)"""

PREFIX_SQL = SCORED_SQL + """,
prefix AS (
    SELECT sequence_name, n, avg(score) OVER (PARTITION BY sequence_name ORDER BY n) AS p, m FROM scored
    QUALIFY n >= 2)"""

TAIL_SQL = SCORED_SQL + """,
sized AS (SELECT *, greatest(1, round_even(0.3 * m, 0)::BIGINT) AS k FROM scored),
tail AS (
    SELECT a.sequence_name, a.n, a.k, avg(b.score) AS p
    FROM sized a JOIN sized b ON a.sequence_name = b.sequence_name AND b.n > a.n - a.k AND b.n <= a.n
    WHERE a.n >= 2 GROUP BY ALL)"""


# --- lineitem: ordered frames per supplier ------------------------------------------------

FRAME_ORDER = [
    "l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a supplier with a four-channel vector and a sparse failure label."""
    failed = (F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("seq"),
        *FRAME_ORDER,
        F.array("l_quantity", F.col("l_extendedprice") / 1000.0, "l_discount", "l_tax").alias("kin"),
        F.when(failed, 1.0).otherwise(0.0).alias("label"),
    )


FRAMES_SQL = f"""frames AS (
    SELECT l_suppkey AS seq, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(FRAME_ORDER)}) - 1 AS i,
           count(*) OVER (PARTITION BY l_suppkey) AS n,
           l_quantity AS c0, l_extendedprice / 1000.0 AS c1, l_discount AS c2, l_tax AS c3,
           CASE WHEN l_quantity >= 49 AND l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
    FROM lineitem)"""


def windows_sql(length: int, stride: int) -> str:
    """CTEs ``frames`` and ``ticks``: one row per (window, tick)."""
    return FRAMES_SQL + f""",
heads AS (
    SELECT seq, unnest(range(0, (n - {length}) // {stride} + 1)) AS win
    FROM (SELECT DISTINCT seq, n FROM frames) WHERE n >= {length}),
ticks AS (
    SELECT h.seq, h.win, f.i - h.win * {stride} AS pos, f.* EXCLUDE (seq)
    FROM heads h JOIN frames f ON f.seq = h.seq AND f.i BETWEEN h.win * {stride} AND h.win * {stride} + {length - 1})"""


# --- embeddings: descriptor vectors, bags of ten, and scores ------------------------------

def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, seq, idx, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / 10).alias("seq"),
        (F.col("vec_id") % 10).alias("idx"),
        "embedding",
        "label",
    )


DESCRIPTORS_SQL = """descriptors AS (
    SELECT vec_id, vec_id // 10 AS seq, vec_id % 10 AS idx, embedding::DOUBLE[] AS embedding, label
    FROM embeddings)"""

CELLS_SQL = DESCRIPTORS_SQL + """,
cells AS (
    SELECT vec_id, seq, idx, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x
    FROM descriptors)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_name, dataset_id, split, p, y): a score per vector, validation or test."""
    first = F.get(F.col("embedding"), F.lit(0)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sequence_name"),
        F.concat(F.lit("d"), (F.col("label") % 3).cast("string")).alias("dataset_id"),
        F.when(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1) < "8", "val").otherwise("test").alias("split"),
        F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * first)), 3).alias("p"),
        (F.col("label") % 2).alias("y"),
    )


SCORES_SQL = """scores AS (
    SELECT vec_id AS sequence_name, 'd' || (label % 3)::VARCHAR AS dataset_id,
           CASE WHEN substr(md5(vec_id::VARCHAR), 1, 1) < '8' THEN 'val' ELSE 'test' END AS split,
           round(1.0 / (1.0 + exp(-8.0 * embedding[1]::DOUBLE)), 3) AS p, label % 2 AS y
    FROM embeddings)"""


# --- orders: labelled sequences of five datasets -------------------------------------------

def order_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, sequence_name, label): finished orders count as failures."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset_id"),
        F.col("o_orderkey").alias("sequence_name"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


POOLS_SQL = """pools AS (
    SELECT o_orderpriority AS dataset_id, o_orderkey AS sequence_name,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, sequence_name, label): small datasets with rare failures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("sequence_name"), F.col("toxic").alias("label")
    )


LABELLED_SQL = """labelled AS (
    SELECT source AS dataset_id, doc_id AS sequence_name, toxic AS label FROM documents JOIN labels USING (doc_id))"""
