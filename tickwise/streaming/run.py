"""Recordings as streams, and running a stream to the end of its input into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.session import scratch_dir


def read_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None,
               files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def replay(rows: DataFrame, time: str, slices: int, end_after: int | None = None, order: Sequence[int] | None = None) -> DataFrame:
    """A recorded table as a stream of ``slices`` batches of equal spans of time (integers).

    ``order`` delivers the slices in another order than that of time. ``end_after`` appends a
    marker, a row that is null but for its time: that long after the last one, so that watermarks
    pass everything. The first slice begins with the first row; an empty table gives no batch.
    """
    spark = rows.sparkSession
    folder = scratch_dir(spark, "replay")
    low, high = rows.agg(F.min(time), F.max(time)).first()
    cut = "cast(null as int)" if low is None else f"least((`{time}` - {low}) * {slices} div greatest({high} - {low}, 1), {slices - 1})"
    if low is not None:
        for i in order or range(slices):
            # One file per slice: a batch takes whole files, in the order in which they were written.
            rows.where(F.expr(cut) == i).coalesce(1).write.mode("append").parquet(folder)
        if end_after is not None:
            spark.createDataFrame([(high + end_after,)], f"`{time}` long").select(
                *[F.col(f.name).cast(f.dataType) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
            ).coalesce(1).write.mode("append").parquet(folder)
    else:
        rows.write.mode("append").parquet(folder)
    return read_files(spark, folder, rows.schema, files_per_batch=1)


def run_to_table(stream: DataFrame, label: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Process all available input, append to a table in the shared folder; (table, checkpoint)."""
    spark = stream.sparkSession
    path, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), checkpoint
