"""Measurement streams from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Time origin of the series, seconds since the epoch (2024-01-01).
ORIGIN = 1704067200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) - F.lit(ORIGIN)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, event_id, t, y of the events; one series for each user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return e.select(F.col("user_id").alias("series_id"), "event_id", seconds(F.col("ts")).alias("t"), F.col("value").alias("y"))


def indexed(rows: DataFrame) -> DataFrame:
    """Adds k, the place in the series by time; ties by event_id."""
    return rows.withColumn("k", (F.row_number().over(Window.partitionBy("series_id").orderBy("t", "event_id")) - 1).cast("int"))
