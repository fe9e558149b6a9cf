"""CSV tables of metrics and trajectories, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed column names of the metrics file.
METRICS = ["Filter", "Problem", "RMSE_Overall", "RMSE_Smoothed_Overall", "Median_NEES", "Pct_In_Bounds", "NEES_Valid", "NEES_Total", "Avg_Step_Time_ms", "Total_Time_ms", "Convergence_Time", "Num_Divergences"]


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Header and one row for each metrics row; what never converged or was not timed is an empty cell."""
    metrics.select(*[F.col(c) if c in metrics.columns else F.lit(None).cast("double").alias(c) for c in METRICS]).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"Filter": "string", "Problem": "string", "NEES_Valid": "long", "NEES_Total": "long", "Num_Divergences": "long"}
    return spark.read.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in METRICS)).option("header", True).csv(path)


def trajectory_table(rows: DataFrame, nx: int, lag: int | None = None) -> DataFrame:
    """time, true_x*, filt_x*[, smooth_x*]: rows have series_id, k, t, truth, x and, if ``lag`` is given, smooth.

    ``smooth`` stands at the step that made it and is moved back by the lag; the last rows have none.
    """
    columns = [F.col("t").alias("time"), *[F.col("truth")[i].alias(f"true_x{i}") for i in range(nx)], *[F.col("x")[i].alias(f"filt_x{i}") for i in range(nx)]]
    if lag is not None:
        ahead = F.lead("smooth", lag).over(Window.partitionBy("series_id").orderBy("k"))
        rows = rows.withColumn("_s", ahead)
        columns += [F.col("_s")[i].alias(f"smooth_x{i}") for i in range(nx)]
    return rows.select("series_id", "k", *columns)


def write_trajectories(rows: DataFrame, path: str, nx: int, lag: int | None = None) -> None:
    """One folder for each series, rows in time order."""
    t = trajectory_table(rows, nx, lag)
    t.repartition("series_id").sortWithinPartitions("series_id", "k").drop("k").write.mode("overwrite").partitionBy("series_id").option("header", True).option("nullValue", "").csv(path)
