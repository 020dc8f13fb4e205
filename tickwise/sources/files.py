"""Which episode lies in which file, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwise.operators.ordered import ordered_scan


def file_stem_of_input() -> Column:
    """Stem of the file a row was read from."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")


def episode_index(rows: DataFrame, file: str | Column, episode: str) -> DataFrame:
    """Distinct (file, episode) pairs; only the two columns are read."""
    stem = F.col(file) if isinstance(file, str) else file
    return rows.select(stem.alias("file"), F.col(episode).alias("episode")).distinct()


def episode_file_offset(
    rows: DataFrame, file: str, episode: str, order: list[str], other_total: DataFrame, total: str
) -> DataFrame:
    """First row of every episode in its file, and that position on a clock of another length.

    ``other_total`` has one row per file. The position is ``round(start * total2 / total1)``.
    """
    placed = ordered_scan(rows, [file], order, index="_i", count="_n")
    first = placed.groupBy(file, episode).agg(F.min("_i").alias("start"), F.max("_n").alias("file_rows"))
    return first.join(other_total.select(file, total), file).select(
        file,
        episode,
        "start",
        "file_rows",
        F.bround(F.col("start") * F.col(total) / F.col("file_rows"), 0).cast("long").alias("other_start"),
    )


def require_episode(index: DataFrame, file: str, episode) -> None:
    """Raise if a file has no such episode."""
    hit = index.where((F.col("file") == file) & (F.col("episode") == episode)).limit(1).count()
    if not hit:
        raise ValueError(f"episode {episode} not in {file}")
