"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
session's shared folder and hands the reread rows to the next. A stage works on all rows that its
predecessor kept. All but the last return the columns of ``documents``; the last adds shard and slot.

A null text has no words: it is scored by its metadata, linked with nothing, contains no benchmark
item, and is mixed and sharded like others. Rows that repeat an id and a text count as one document
in de-duplication and as separate documents elsewhere. Extra columns are carried along, whatever
they are called, except size, shard and slot in the last stage, which are replaced.

Stages that call Python set the session's Arrow batches to at most ``ROWS_AT_ONCE`` rows, since a caller
writes their rows after they have returned; ``run`` restores the session's own setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.decontaminate import without_leaks
from tickwise.llm.mixing import mix_sources, n_words
from tickwise.llm.neardup import without_near_duplicates
from tickwise.llm.quality import fit, only_good
from tickwise.llm.sharding import shard_documents
from tickwise.session import BATCH_CONF, small_batches, staged

ROWS_AT_ONCE = 500


def _bounded(spark: SparkSession) -> None:
    """Whole texts pass through Python: by the thousand they would fill an executor's memory on both sides."""
    before = int(spark.conf.get(BATCH_CONF))
    if not 0 < before <= ROWS_AT_ONCE:
        spark.conf.set(BATCH_CONF, str(ROWS_AT_ONCE))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the co-trained classifier rejects."""
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return only_good(docs, fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    _bounded(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their weights."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
        n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("hash"),
    )
    mixed = mix_sources(packed, F.col("words"), key_cols=("doc_id", "hash"))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into one of the shards, balanced by bytes."""
    return shard_documents(docs).drop("size")


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard),
]

#: No stage before sharding can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark, ROWS_AT_ONCE):
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), name)
    return docs
