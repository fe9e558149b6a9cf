"""The accuracy suite: thirteen rows of filter and problem, and its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np

from driftline.operators import kernels, series
from driftline.operators import relational as rel
from driftline.sources import simulate

#: Filter, problem, whether smoothed, published RMSE and smoothed RMSE.
BASELINE = [
    ("UKF", "CoupledOscillators10D", 1.45655, None),
    ("SRUKF", "CoupledOscillators10D", 1.45655, None),
    ("UKF+Smoother", "CoupledOscillators10D", 1.45655, 1.14768),
    ("SRUKF+Smoother", "CoupledOscillators10D", 1.45655, 1.14768),
    ("UKF", "VanDerPol2D", 0.468888, None),
    ("SRUKF", "VanDerPol2D", 0.467096, None),
    ("SRUKF+Smoother", "VanDerPol2D", 0.467096, 0.430381),
    ("UKF", "BearingOnly4D", 63.4902, None),
    ("SRUKF", "BearingOnly4D", 63.8392, None),
    ("SRUKF+Smoother", "BearingOnly4D", 63.8392, 51.6818),
    ("UKF", "ReentryVehicle6D", 366.868, None),
    ("SRUKF", "ReentryVehicle6D", 367.115, None),
    ("SRUKF+Smoother", "ReentryVehicle6D", 367.115, 236.251),
]


def filtered_problem(spark: SparkSession, filter_: str, problem: str, runs: int = 1) -> DataFrame:
    """Filter rows of simulated runs beside their truth: series_id, k, t, truth, x, p, x_smooth, error, smooth_error, nees."""
    p = simulate.PROBLEMS[problem]
    name, smoothed = filter_.split("+")[0].lower(), "+" in filter_
    truth = simulate.simulated(spark, problem, runs)
    est = series.filtered(truth.select("series_id", "t", "y"), lambda: kernels.FILTERS[name](p.model), np.array(p.x0, float), np.diag(np.array(p.p0, float)), "fixed_lag" if smoothed else None, p.lag)
    n = p.model.nx
    norm = lambda c: F.sqrt(F.aggregate(F.zip_with("truth", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))

    @F.pandas_udf("double")
    def nees(x, truth, cov):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=float)
        e, c = np.stack(list(x)) - np.stack(list(truth)), np.stack(list(cov)).reshape(-1, n, n)
        d = np.diagonal(c, axis1=1, axis2=2)
        ok = np.isfinite(c).all((1, 2)) & (d > 0).all(1)
        ok &= np.where(ok, d.max(1) <= 1e8 * np.where(d.min(1) > 0, d.min(1), 1), False)
        out = np.full(len(e), np.nan)
        if ok.any():
            out[ok] = kernels.quadratic(c[ok], e[ok])
        return pd.Series(out)

    rows = est.join(truth.select("series_id", "k", F.col("x").alias("truth")), rel.KEYS)
    return rows.withColumns({"error": norm("x"), "smooth_error": norm("x_smooth"), "nees": nees("x", "truth", "p"), "variance": F.lit(1.0)})


def metrics(spark: SparkSession, filter_: str, problem: str, runs: int = 1) -> DataFrame:
    """One metrics row for each run."""
    p = simulate.PROBLEMS[problem]
    rows = filtered_problem(spark, filter_, problem, runs)
    base = rows.groupBy("series_id").agg(F.sqrt(F.sum(F.col("error") * F.col("error")) / F.count(F.lit(1))).alias("RMSE_Overall"), F.coalesce(F.sqrt(F.avg(F.col("smooth_error") * F.col("smooth_error"))), F.lit(0.0)).alias("RMSE_Smoothed_Overall"))
    out = base.join(rel.nees_consistency(rows, p.model.nx), "series_id").join(rel.convergence_time(rows, 1.0), "series_id").join(rel.divergences(rows, p.diverged), "series_id")
    return out.select(F.lit(filter_).alias("Filter"), F.lit(problem).alias("Problem"), "series_id", "RMSE_Overall", "RMSE_Smoothed_Overall", F.col("median_nees").alias("Median_NEES"), F.col("pct_in_bounds").alias("Pct_In_Bounds"), F.col("nees_valid").alias("NEES_Valid"), F.col("nees_total").alias("NEES_Total"), F.col("convergence_time").alias("Convergence_Time"), F.col("num_divergences").alias("Num_Divergences"))


def suite(spark: SparkSession) -> DataFrame:
    """All thirteen rows."""
    parts = [metrics(spark, f, p) for f, p, _, _ in BASELINE]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate(spark: SparkSession, rows: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Each row with its baseline and ``passed``: RMSE within tolerance both ways, at least 80 % in bounds, no divergence, smoothing helps."""
    base = spark.createDataFrame(BASELINE, "Filter string, Problem string, base double, base_smoothed double")
    near = lambda a, b: F.abs(F.col(a) / F.col(b) - 1) <= tolerance
    smooth_ok = F.col("base_smoothed").isNull() | (near("RMSE_Smoothed_Overall", "base_smoothed") & (F.col("RMSE_Smoothed_Overall") < F.col("RMSE_Overall")))
    ok = near("RMSE_Overall", "base") & (F.col("Pct_In_Bounds") >= 80) & (F.col("Num_Divergences") == 0) & smooth_ok
    return rows.join(F.broadcast(base), ["Filter", "Problem"], "left").withColumn("passed", F.coalesce(ok, F.lit(False)))  # thirteen rows
