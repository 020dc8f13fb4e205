"""Feature tables, pools, scalers and run reports on disk (Parquet and JSON)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.operators.features import union_datasets
from tickwise.operators.ordered import quoted


def feature_table_write(features: DataFrame, path: str, dataset: str, mode: str = "append") -> None:
    """Persist features partitioned by dataset, so that reading one dataset prunes the rest."""
    features.write.mode(mode).partitionBy(dataset).parquet(path)


BUCKETS = 512


def bucketed_table_write(features: DataFrame, table: str, path: str, seq: str, time: str, buckets: int = BUCKETS) -> None:
    """Persist features in buckets by sequence, sorted by time, as the catalog's table ``table``.

    Windows, differences and joins by sequence over :func:`bucketed_table_read` need no shuffle.
    The rows are placed by sequence first, so that every bucket is one file; a sequence is in one
    bucket, whose size therefore has to suit one task.
    """
    placed = features.repartition(buckets, quoted(seq))
    placed.write.bucketBy(buckets, seq).sortBy(seq, time).mode("overwrite").option("path", path).saveAsTable(table)


def bucketed_table_read(spark: SparkSession, table: str) -> DataFrame:
    """A bucketed table; scans keep the buckets as partitions."""
    return spark.table(table)


def _manifest(path: str) -> str:
    return f"{path}/manifest"


def _run_folder(path: str, run: str) -> str:
    return f"{path}/rows/run={run}"


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs of a table that were written to the end, in order of their names."""
    records = read_or_none(spark, _manifest(path), "run string, n_rows long", "json")
    return [] if records is None else sorted({r["run"] for r in records.select("run").collect()})


def commit_features(features: DataFrame, path: str, dataset: str, run: str) -> bool:
    """Write the rows of one run and then its commit record; False if the run is there already.

    A run that died half way has no record, so nobody reads its rows; started again under the same
    name it replaces them, under another name they stay unread. The record is the last thing
    written, a file of its own, so runs do not wait for each other.
    """
    spark = features.sparkSession
    if run in committed_runs(spark, path):
        return False
    folder = _run_folder(path, run)
    features.write.mode("overwrite").partitionBy(dataset).parquet(folder)
    rows = spark.read.schema(features.schema).parquet(folder)
    rows.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n_rows")).coalesce(1).write.mode("append").json(_manifest(path))
    return True


def committed_features(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """The rows of all committed runs with the ``run`` they came with, or ``None`` before the first commit."""
    runs = committed_runs(spark, path)
    if not runs:
        return None
    reader = spark.read.option("basePath", f"{path}/rows")
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(*[_run_folder(path, r) for r in runs])


def read_or_none(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, source: str = "parquet"
) -> DataFrame | None:
    """A table of files, or ``None`` where there is none yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.format(source).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def incremental_todo(names: DataFrame, done: DataFrame | None, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Sequences still to build: all of them when forced or when nothing exists."""
    if force or done is None:
        return names
    return names.join(done.select(*keys).distinct(), list(keys), "left_anti")


def feature_table_index(
    spark: SparkSession, root: str, datasets: Sequence[str], dataset: str, overrides: Mapping[str, str] | None = None,
    schema: T.StructType | str | None = None,
) -> tuple[DataFrame | None, list[str]]:
    """Read each dataset from its own folder (``overrides`` first); returns (rows, missing ids)."""
    parts, missing = [], []
    for d in datasets:
        path = (overrides or {}).get(d, f"{root}/{dataset}={d}")
        part = read_or_none(spark, path, schema)
        if part is None:
            missing.append(d)
        else:
            parts.append(part.withColumn(dataset, F.lit(d)))
    return (union_datasets(parts) if parts else None), missing


def pools_write(pools: DataFrame, path: str, generated_at: str) -> None:
    """Pools as JSON lines (dataset, outcome, sequence, generation time), one file set per dataset."""
    pools.withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(path)


POOLS_SCHEMA = "dataset_id string, outcome string, sequence_name string, generated_at string"


def pools_read(spark: SparkSession, path: str, schema: str = POOLS_SCHEMA) -> DataFrame:
    """Pools from JSON lines."""
    return spark.read.schema(schema).json(path)


def run_report(
    counts: DataFrame, metrics: DataFrame, on: Sequence[str], config: Mapping[str, str], path: str | None = None
) -> DataFrame:
    """Per-run record: configuration, counts and metrics side by side; written as JSON if asked."""
    report = counts.join(metrics, list(on), "full_outer").withColumn(
        "config", F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(config.items()) for x in kv]))
    )
    if path:
        report.write.mode("overwrite").json(path)
    return report
