"""Metrics, weights, resampling, ancestry, moments and densities as plain DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["series_id", "k"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# --- accuracy and consistency -------------------------------------------------------------------

def rmse(rows: DataFrame, truth: list[str], estimate: list[str], by: list[str], per_component: bool = False) -> DataFrame:
    """Vector RMSE by group: root of summed squared error over steps (and over components, if asked)."""
    sq = sum(((F.col(e) - F.col(t)) * (F.col(e) - F.col(t)) for t, e in zip(truth, estimate, strict=True)), F.lit(0.0))
    n = F.count(F.lit(1)) * (len(truth) if per_component else 1)
    return rows.groupBy(*by).agg(F.sqrt(F.sum(sq) / n).alias("rmse"), F.count(F.lit(1)).alias("n_steps"))


def chi2_bounds(n: int) -> tuple[float, float]:
    """Wilson-Hilferty quantiles at 2.5 and 97.5 percent."""
    wh = lambda z: n * (1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n))) ** 3
    return wh(-1.96), wh(1.96)


def nees_consistency(rows: DataFrame, dim: int = 1, least: int = 20) -> DataFrame:
    """Median NEES and share in bounds by series after the first tenth; null where fewer rows than ``least`` count.

    ``rows`` has series_id, k, nees and variance; rows with a bad variance or NEES do not count.
    """
    lower, upper = chi2_bounds(dim)
    w = Window.partitionBy("series_id")
    kept = rows.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("k") >= F.floor(F.col("n") / 10))
    valid = finite(F.col("variance")) & (F.col("variance") > 0) & finite(F.col("nees")) & (F.col("nees") >= 0)
    out = kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("nees_total"), F.count_if(valid).alias("nees_valid"), F.median(F.when(valid, F.col("nees"))).alias("m"), (100.0 * F.avg(F.when(valid, F.col("nees").between(lower, upper).cast("double")))).alias("b"))
    enough = F.col("nees_valid") >= least
    return out.select("series_id", F.when(enough, F.col("m")).alias("median_nees"), F.when(enough, F.col("b")).alias("pct_in_bounds"), "nees_valid", "nees_total")


def convergence_time(rows: DataFrame, threshold: float, window: int = 50) -> DataFrame:
    """First time at which the last ``window`` errors (and one row more before them) all stay within the threshold; null if none.

    A NaN error counts as not converged.
    """
    w = Window.partitionBy("series_id").orderBy("k")
    worst = F.max(F.when(F.isnan("error"), F.lit(float("inf"))).otherwise(F.col("error"))).over(w.rowsBetween(-(window - 1), 0))
    seen = rows.withColumn("worst", worst).withColumn("at", F.row_number().over(w))
    return seen.groupBy("series_id").agg(F.min(F.when((F.col("at") > window) & (F.col("worst") <= threshold), F.col("t"))).alias("convergence_time"))


def divergences(rows: DataFrame, threshold: float) -> DataFrame:
    """Errors beyond the threshold by series; NaN diverges."""
    return rows.groupBy("series_id").agg(F.count_if(F.isnan("error") | (F.col("error") > threshold)).alias("num_divergences"), F.count(F.lit(1)).alias("n_steps"))


def innovation_gate(rows: DataFrame, gate: float, reject: bool = False) -> DataFrame:
    """Adds gated and the update's scale for a column ``nis``."""
    out = F.lit(0.0) if reject else F.sqrt(F.lit(gate) / F.greatest("nis", F.lit(gate)))
    return rows.withColumns({"gated": F.col("nis") > gate, "scale": F.when(F.col("nis") > gate, out).otherwise(F.lit(1.0))})


# --- weights and resampling ---------------------------------------------------------------------

def normalized(particles: DataFrame, by: list[str]) -> DataFrame:
    """Log weights less their log-sum-exp; groups with no finite weight become uniform, dead particles stay dead."""
    w = Window.partitionBy(*by)
    ok = finite(F.col("log_w"))
    top = F.max(F.when(ok, F.col("log_w"))).over(w)
    d = particles.withColumn("_top", top)
    d = d.withColumn("_sum", F.sum(F.when(ok, F.exp(F.col("log_w") - F.col("_top"))).otherwise(0.0)).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    value = F.when(F.col("_top").isNull() | (F.col("_sum") <= 0), -F.log(F.col("_n").cast("double"))).when(ok, F.col("log_w") - F.col("_top") - F.log("_sum")).otherwise(F.lit(float("-inf")))
    return d.withColumn("log_w", value).drop("_top", "_sum", "_n")


def effective_size(particles: DataFrame, by: list[str]) -> DataFrame:
    """1 / sum of squared weights, clamped to [1, N]; weights are normalised."""
    g = particles.groupBy(*by).agg(F.sum(F.exp(2 * F.col("log_w"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.least(F.greatest(F.try_divide(F.lit(1.0), F.col("s")), F.lit(1.0)), F.col("n").cast("double")).alias("ess"), "n")


def resample(particles: DataFrame, by: list[str], uniforms: Column, scheme: str) -> DataFrame:
    """parent of each place i: the first particle whose cumulative weight reaches (i + u) / N, at most N - 1.

    Systematic: one u for the group (of place 0); stratified: one for each place. The cumulative
    weights meet the probe points by merging both, sorted, in one window pass: there is no pair of
    probe and interval, whatever the group's size.
    """
    w = Window.partitionBy(*by)
    rows = particles.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("cum", F.sum(F.exp("log_w")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("u", uniforms)
    if scheme == "systematic":
        rows = rows.withColumn("u", F.max(F.when(F.col("i") == 0, F.col("u"))).over(w))
    points = rows.select(*by, "n", F.lit(0).alias("kind"), "i", ((F.col("i") + F.col("u")) / F.col("n")).alias("at"))
    steps = rows.select(*by, "n", F.lit(1).alias("kind"), "i", F.col("cum").alias("at"))
    # a probe's parent is the number of cumulative weights strictly below it
    both = points.unionByName(steps).withColumn("below", F.sum("kind").over(w.orderBy("at", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("kind = 0").select(*by, "i", F.least("below", F.col("n") - 1).cast("int").alias("parent"))


def gather(particles: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
    """The parents' states in their children's places, with even weights."""
    of = particles.select(*by, F.col("i").alias("parent"), "x")
    n = Window.partitionBy(*by)
    return parents.join(of, [*by, "parent"]).withColumn("log_w", -F.log(F.count(F.lit(1)).over(n).cast("double")))


def backtrack(edges: DataFrame, by: str, last: int, lag: int) -> DataFrame:
    """ancestor of each place i at step ``last``, ``lag`` steps earlier: chained joins of (by, k, i, parent)."""
    path = edges.where(F.col("k") == last).select(by, "i", F.col("parent").alias("ancestor"))
    for step in range(1, lag):
        earlier = edges.where(F.col("k") == last - step).select(by, F.col("i").alias("ancestor"), F.col("parent").alias("up"))
        path = path.join(earlier, [by, "ancestor"]).select(by, "i", F.col("up").alias("ancestor"))
    return path


def moments(particles: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """Weighted mean and (biased) covariance of normalised particles, as mean_<x> and cov_<x>_<y>."""
    e = F.exp("log_w")
    sums = particles.groupBy(*by).agg(F.sum(e).alias("w"), *[F.sum(e * F.col(x)).alias(f"s_{x}") for x in xs])
    centred = particles.join(sums, by)
    d = {x: F.col(x) - F.col(f"s_{x}") for x in xs}
    pairs = [(a, b) for k, a in enumerate(xs) for b in xs[k:]]
    return centred.groupBy(*by).agg(*[F.first(f"s_{x}").alias(f"mean_{x}") for x in xs], *[F.sum(e * d[a] * d[b]).alias(f"cov_{a}_{b}") for a, b in pairs])


# --- densities and angles -----------------------------------------------------------------------

def gaussian_logpdf(x: list[Column], mean: list[float], var: list[float]) -> Column:
    """Of a diagonal covariance."""
    q = sum(((a - m) * (a - m) / v for a, m, v in zip(x, mean, var, strict=True)), F.lit(0.0))
    return F.lit(-0.5) * (q + sum(math.log(v) for v in var) + len(var) * math.log(2 * math.pi))


def student_t_logpdf(x: list[Column], mean: list[float], var: list[float], nu: float) -> Column:
    """Of a diagonal scale matrix; the gamma functions are constants."""
    p = len(var)
    q = sum(((a - m) * (a - m) / v for a, m, v in zip(x, mean, var, strict=True)), F.lit(0.0))
    const = math.lgamma((nu + p) / 2) - math.lgamma(nu / 2) - 0.5 * sum(math.log(v) for v in var) - p / 2 * math.log(nu * math.pi)
    return F.lit(const) - F.lit((nu + p) / 2) * F.log1p(q / nu)


def wrap_angle(d: Column) -> Column:
    """Into [-pi, pi], ties to even, as the IEEE remainder."""
    return d - F.lit(2 * math.pi) * F.rint(d / F.lit(2 * math.pi))


def circular_mean(angle: Column, weight: Column) -> Column:
    return F.atan2(F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle)))


# --- joins --------------------------------------------------------------------------------------

def lag_aligned(smoothed: DataFrame, truth: DataFrame, lag: int) -> DataFrame:
    """Smoothed rows, stored at the step that made them, beside the truth ``lag`` steps earlier."""
    return smoothed.withColumn("k", F.col("k") - lag).join(truth, KEYS)


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Each left row with the last right value strictly before its time: one union and one window, no range join."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(by, time, F.col(value).alias("_v"), F.lit(2).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    # at equal times left rows come first, so they see earlier values only
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")
