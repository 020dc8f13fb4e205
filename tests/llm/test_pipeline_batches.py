"""Stages of the pipeline hand whole texts to Python in small batches."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickwise.llm import decontaminate
from tickwise.session import BATCH_CONF


@pytest.mark.parametrize("before, most", [("10000", corpus_pipeline.ROWS_AT_ONCE), ("0", corpus_pipeline.ROWS_AT_ONCE), ("40", 40)])
def test_rows_of_a_stage_come_in_small_batches(spark, monkeypatch, tmp_path, before, most):
    def sizes(docs, benchmark):
        def count(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        return docs.mapInArrow(count, "n long")

    monkeypatch.setattr(corpus_pipeline, "without_leaks", sizes)
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(0, 1_200, 1, 1).select(F.col("id").alias("doc_id"), F.lit("words of a text").alias("text"))
    was = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, before)
    try:
        got = [r.n for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()]
    finally:
        spark.conf.set(BATCH_CONF, was)
    assert sum(got) == 1_200 and max(got) == most


def test_run_restores_the_session(spark, monkeypatch, tmp_path):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, docs, _: seen.append(s.conf.get(BATCH_CONF)) or docs)])
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get(BATCH_CONF)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert seen == [str(corpus_pipeline.ROWS_AT_ONCE)] and spark.conf.get(BATCH_CONF) == was
    assert decontaminate.ROWS_AT_ONCE == corpus_pipeline.ROWS_AT_ONCE
