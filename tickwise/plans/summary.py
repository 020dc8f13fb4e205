"""The smallest whole job: align, difference, label and summarise every sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.operators.align import finite_difference, grid_hot_keys
from tickwise.operators.metrics import sequence_summary
from tickwise.queries import query
from tickwise.queries.align_labels import GRID_SQL, held
from tickwise.queries.common import HOUR_US, q6, r6, samples


@query(
    "aligned_summary",
    f"""WITH {GRID_SQL}, rates AS (
        SELECT sequence_name, coalesce(click - lag(click) OVER w, 0.0) / 3600.0::DOUBLE AS click_rate,
               CASE WHEN error > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
        FROM held WHERE click IS NOT NULL AND view IS NOT NULL WINDOW w AS (PARTITION BY sequence_name ORDER BY tick))
    SELECT sequence_name, count(*) AS rows, {q6('avg(label)')} AS pos_ratio, 5::BIGINT AS n_features,
           {q6('avg(abs(click_rate))')} AS mean_rate FROM rates GROUP BY 1""",
)
def aligned_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly grid of all topics per user; mean absolute rate of one, and the share of failure ticks."""
    long_grids = grid_hot_keys(samples(spark, sf_dir), "sequence_name", "t", HOUR_US)
    ticks = held(spark, sf_dir).na.drop(subset=["click", "view"])
    rates = finite_difference(ticks, ["sequence_name"], "t", {"click_rate": "click"}, 1e6, hot=long_grids)
    labelled = rates.withColumn("label", F.when(F.col("error") > 100, 1.0).otherwise(0.0))
    return sequence_summary(
        labelled, ["sequence_name"], "label", 5, {"mean_rate": F.avg(F.abs("click_rate"))}
    ).withColumns({c: r6(c) for c in ("pos_ratio", "mean_rate")})
