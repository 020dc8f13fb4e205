"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "tickwise") -> SparkSession:
    """A local session as the tests and the bench use it. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside, so that long texts fill no memory."""
    before = int(spark.conf.get(BATCH_CONF))
    spark.conf.set(BATCH_CONF, str(min(before, rows) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, str(before))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder every executor can reach")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; nothing is created yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder once and read it back.

    Cuts the lineage for results that several branches use; what is written outlives the
    executor that wrote it, and later passes read only the columns they need.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
