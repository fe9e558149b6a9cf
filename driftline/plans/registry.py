"""All registered queries and, where SQL can say it, the SQL that gives the same rows.

Streams come from the events table: one series for each user. Where a query needs randomness it takes
uniforms from arithmetic on ids, which any engine repeats.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import models
from driftline.operators import filters1d
from driftline.operators import relational as rel
from driftline.plans.sqlfold import EV, fold, rounded
from driftline.sources.events import indexed, measurements, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rd(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(v).cast("double"), digits).alias(v) for v in values])


# --- filters ------------------------------------------------------------------------------------

KF_COLUMNS = ["x_pred", "p_pred", "x_filt", "p_filt", "innovation", "nis"]


def kf_sql(q=1.0, r=25.0, x0=0.0, p0=100.0, a=1.0, bias=0.0, h=1.0, offset=0.0) -> str:
    return fold(
        {"x_filt": x0, "p_filt": p0},
        [
            {"x_pred": f"CASE WHEN k = 0 THEN prev_x_filt ELSE {a} * prev_x_filt + {bias} END", "p_pred": f"CASE WHEN k = 0 THEN prev_p_filt ELSE {a} * {a} * prev_p_filt + {q} END"},
            {"innovation": f"y - ({h} * x_pred + {offset})", "s": f"{h} * {h} * p_pred + {r}"},
            {"g": f"p_pred * {h} / s"},
            {"x_filt": "x_pred + g * innovation", "p_filt": f"(1 - g * {h}) * (1 - g * {h}) * p_pred + g * g * {r}", "nis": "innovation * innovation / s"},
        ],
        KF_COLUMNS,
    )


@query(f"WITH RECURSIVE {EV}, {kf_sql()} SELECT series_id AS user_id, k, event_id, {rounded(KF_COLUMNS)} FROM f")
def kf1d_filter(spark, sf_dir):
    """Random-walk Kalman filter of each user's values (linear predict, update, initialise)."""
    out = filters1d.kalman_1d(measurements(spark, sf_dir)).withColumnRenamed("series_id", "user_id")
    return rd(out, ["user_id", "k", "event_id"], KF_COLUMNS)


@query(f"WITH RECURSIVE {EV}, {kf_sql(a=0.95, bias=2.0, h=0.5, offset=3.0, q=4.0)} SELECT series_id, k, event_id, {rounded(KF_COLUMNS)} FROM f")
def kf1d_affine_offset(spark, sf_dir):
    """The same with a bias in the dynamics and an affine observation."""
    return rd(filters1d.kalman_1d(measurements(spark, sf_dir), a=0.95, bias=2.0, h=0.5, offset=3.0, q=4.0), ["series_id", "k", "event_id"], KF_COLUMNS)


CV = ["x", "v", "pxx", "pxv", "pvv", "innovation"]
CV_SQL = fold(
    {"x": 0.0, "v": 0.0, "pxx": 100.0, "pxv": 0.0, "pvv": 1.0, "t": 0.0},
    [
        {"d": "CASE WHEN k = 0 THEN 0.0 ELSE (t - prev_t) / 3600.0 END"},
        {"xp": "prev_x + d * prev_v", "a": "prev_pxx + 2 * d * prev_pxv + d * d * prev_pvv + 1e-9 * d * d * d / 3", "b": "prev_pxv + d * prev_pvv + 1e-9 * d * d / 2", "c": "prev_pvv + 1e-9 * d"},
        {"ga": "a / (a + 25.0)", "gb": "b / (a + 25.0)", "innovation": "y - xp"},
        {"x": "xp + ga * innovation", "v": "prev_v + gb * innovation", "pxx": "(1 - ga) * a", "pxv": "(1 - ga) * b", "pvv": "c - gb * b"},
    ],
    CV,
)


@query(f"WITH RECURSIVE {EV}, {CV_SQL} SELECT series_id, k, event_id, {rounded(CV)} FROM f")
def kf2d_constant_velocity(spark, sf_dir):
    """Constant-velocity filter over irregular times."""
    return rd(filters1d.kalman_cv(measurements(spark, sf_dir)), ["series_id", "k", "event_id"], CV)


XP = ["x", "p", "innovation", "nis"]
EKF_SQL = fold(
    {"x": 50.0, "p": 400.0},
    [
        {"pp": "CASE WHEN k = 0 THEN prev_p ELSE prev_p + 1.0 END", "h": "1 + 2 * 0.004 * prev_x"},
        {"s": "h * h * pp + 25.0", "innovation": "y - prev_x * (1 + 0.004 * prev_x)"},
        {"g": "pp * h / s"},
        {"x": "prev_x + g * innovation", "p": "(1 - g * h) * (1 - g * h) * pp + g * g * 25.0", "nis": "innovation * innovation / s"},
    ],
    XP,
)


@query(f"WITH RECURSIVE {EV}, {EKF_SQL} SELECT series_id, k, event_id, {rounded(XP)} FROM f")
def ekf1d_nonlinear_obs(spark, sf_dir):
    """Extended filter with a quadratic observation."""
    return rd(filters1d.ekf_1d(measurements(spark, sf_dir)), ["series_id", "k", "event_id"], XP)


UKF_SQL = fold(
    {"x": 50.0, "p": 400.0},
    [
        {"pp": "CASE WHEN k = 0 THEN prev_p ELSE prev_p + 1.0 END"},
        {"l": "sqrt(pp)"},
        {"y0": "prev_x * (1 + 0.004 * prev_x)", "y1": "(prev_x + l) * (1 + 0.004 * (prev_x + l))", "y2": "(prev_x - l) * (1 + 0.004 * (prev_x - l))"},
        {"m": "(y1 + y2) / 2"},
        {"s": "2.999999 * (y0 - m) * (y0 - m) + ((y1 - m) * (y1 - m) + (y2 - m) * (y2 - m)) / 2 + 25.0", "pxy": "l * (y1 - y2) / 2", "innovation": "y - m"},
        {"g": "pxy / s"},
        {"x": "prev_x + g * innovation", "p": "pp - 2 * g * pxy + g * g * s", "nis": "innovation * innovation / s"},
    ],
    XP,
)


@query(f"WITH RECURSIVE {EV}, {UKF_SQL} SELECT series_id, k, event_id, {rounded(XP)} FROM f")
def ukf1d_filter(spark, sf_dir):
    """Unscented filter of the same model, sigma points in closed form."""
    return rd(filters1d.ukf_1d(measurements(spark, sf_dir)), ["series_id", "k", "event_id"], XP)


SR = ["x", "s", "nis", "scale", "gated"]
SR_SQL = fold(
    {"x": 50.0, "s": 10.0},
    [
        {"sp": "CASE WHEN k = 0 THEN prev_s ELSE sqrt(prev_s * prev_s + 1.0) END"},
        {"pyy": "sp * sp + 25.0", "nu": "y - prev_x"},
        {"g": "sp * sp / pyy", "nis": "nu * nu / pyy"},
        {"scale": "CASE WHEN nis > 4.0 THEN sqrt(4.0 / nis) ELSE 1.0 END", "gated": "CASE WHEN nis > 4.0 THEN 1.0 ELSE 0.0 END"},
        {"x": "prev_x + scale * g * nu", "s": "sqrt(sp * sp - (2 * scale - scale * scale) * g * g * pyy)"},
    ],
    SR,
)


@query(f"WITH RECURSIVE {EV}, {SR_SQL} SELECT series_id, k, event_id, {rounded(['x', 's', 'nis', 'scale'])}, CAST(gated AS DOUBLE) AS gated FROM f")
def srukf1d_gated(spark, sf_dir):
    """Square-root unscented filter with the innovation gate."""
    return rd(filters1d.srukf_1d_gated(measurements(spark, sf_dir)), ["series_id", "k", "event_id"], SR)


@query(f"WITH RECURSIVE {EV}, {kf_sql()} SELECT series_id, k, round(nis, 6) AS nis, nis > 3.84 AS gated, round(CASE WHEN nis > 3.84 THEN sqrt(3.84 / nis) ELSE 1.0 END, 6) AS scale FROM f")
def nis_gate(spark, sf_dir):
    """Gate on the linear filter's NIS."""
    out = rel.innovation_gate(filters1d.kalman_1d(measurements(spark, sf_dir)).select("series_id", "k", "nis"), 3.84)
    return out.select("series_id", "k", F.round("nis", 6).alias("nis"), "gated", F.round("scale", 6).alias("scale"))


# --- smoothers ----------------------------------------------------------------------------------

BACK = """n AS (SELECT series_id, max(k) AS last FROM f GROUP BY series_id),
b AS (
    SELECT f.series_id, f.k, x_filt AS x_smooth, p_filt AS p_smooth FROM f JOIN n ON f.series_id = n.series_id AND f.k = n.last
    UNION ALL
    SELECT f.series_id, f.k, f.x_filt + f.p_filt / (f.p_filt + 1.0) * (b.x_smooth - f.x_filt),
           f.p_filt + (f.p_filt / (f.p_filt + 1.0)) * (f.p_filt / (f.p_filt + 1.0)) * (b.p_smooth - f.p_filt - 1.0)
    FROM b JOIN f ON f.series_id = b.series_id AND f.k = b.k - 1
)"""


@query(f"WITH RECURSIVE {EV}, {kf_sql()}, {BACK} SELECT series_id, k, {rounded(['x_smooth', 'p_smooth'])} FROM b")
def rts1d_full_interval(spark, sf_dir):
    """Full-interval smoother."""
    return rd(filters1d.rts_1d(filters1d.kalman_1d(measurements(spark, sf_dir))), ["series_id", "k"], ["x_smooth", "p_smooth"])


LAG = 5
LAG_SQL = f"""w AS (
    SELECT series_id, k AS top, k, x_filt AS x_smooth, p_filt AS p_smooth, 0 AS back FROM f
    UNION ALL
    SELECT w.series_id, w.top, f.k, f.x_filt + f.p_filt / (f.p_filt + 1.0) * (w.x_smooth - f.x_filt),
           f.p_filt + (f.p_filt / (f.p_filt + 1.0)) * (f.p_filt / (f.p_filt + 1.0)) * (w.p_smooth - f.p_filt - 1.0), w.back + 1
    FROM w JOIN f ON f.series_id = w.series_id AND f.k = w.k - 1 WHERE w.back < {LAG}
)"""


@query(f"WITH RECURSIVE {EV}, {kf_sql()}, {LAG_SQL} SELECT series_id, k, {rounded(['x_smooth', 'p_smooth'])} FROM w WHERE back = {LAG}")
def rts1d_fixed_lag(spark, sf_dir):
    """Fixed-lag smoother: row k from rows up to k + 5."""
    return rd(filters1d.rts_1d(filters1d.kalman_1d(measurements(spark, sf_dir)), lag=LAG), ["series_id", "k"], ["x_smooth", "p_smooth"])


# --- accuracy and consistency -------------------------------------------------------------------

def filtered_errors(spark, sf_dir) -> DataFrame:
    """Filter rows with the measurement as stand-in for the truth."""
    f = filters1d.kalman_1d(measurements(spark, sf_dir))
    return f.select("series_id", "k", "t", "y", "x_filt", F.abs(F.col("x_filt") - F.col("y")).alias("error"), F.col("p_filt").alias("variance"), ((F.col("x_filt") - F.col("y")) * (F.col("x_filt") - F.col("y")) / F.col("p_filt")).alias("nees"))


ERR = f"{EV}, {kf_sql()}, e AS (SELECT series_id, k, t, y, x_filt, abs(x_filt - y) AS error, p_filt AS variance, (x_filt - y) * (x_filt - y) / p_filt AS nees FROM f)"


@query(f"WITH RECURSIVE {ERR} SELECT series_id, round(sqrt(sum(error * error) / count(*)), 6) AS rmse, count(*) AS n_steps FROM e GROUP BY series_id")
def rmse_by_series(spark, sf_dir):
    out = rel.rmse(filtered_errors(spark, sf_dir), ["y"], ["x_filt"], ["series_id"])
    return out.select("series_id", F.round("rmse", 6).alias("rmse"), "n_steps")


@query("SELECT l_returnflag, round(sqrt(sum((l_discount - 0.05) * (l_discount - 0.05) + (l_tax - 0.04) * (l_tax - 0.04)) / (2 * count(*))), 6) AS rmse, count(*) AS n_steps FROM lineitem GROUP BY l_returnflag")
def indexed_rmse(spark, sf_dir):
    """Per-component RMSE over a chosen subset of components."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("b"), F.lit(0.05).alias("ta"), F.lit(0.04).alias("tb"))
    out = rel.rmse(rows, ["ta", "tb"], ["a", "b"], ["l_returnflag"], per_component=True)
    return out.select("l_returnflag", F.round("rmse", 6).alias("rmse"), "n_steps")


CHI = rel.chi2_bounds(1)


@query(f"""WITH RECURSIVE {ERR}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM e)
SELECT series_id, CASE WHEN count(*) >= 20 THEN round(median(nees), 6) END AS median_nees,
       CASE WHEN count(*) >= 20 THEN round(100.0 * avg(CASE WHEN nees BETWEEN {CHI[0]!r} AND {CHI[1]!r} THEN 1.0 ELSE 0.0 END), 6) END AS pct_in_bounds,
       count(*) AS nees_valid, count(*) AS nees_total
FROM c WHERE k >= floor(n / 10) AND variance > 0 GROUP BY series_id""")
def nees_consistency(spark, sf_dir):
    out = rel.nees_consistency(filtered_errors(spark, sf_dir))
    return out.select("series_id", F.round("median_nees", 6).alias("median_nees"), F.round("pct_in_bounds", 6).alias("pct_in_bounds"), "nees_valid", "nees_total")


@query(f"""WITH RECURSIVE {ERR}, c AS (SELECT *, max(error) OVER w AS worst, row_number() OVER (PARTITION BY series_id ORDER BY k) AS nth FROM e
    WINDOW w AS (PARTITION BY series_id ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT series_id, round(min(CASE WHEN nth > 10 AND worst <= 60.0 THEN t END), 6) AS convergence_time FROM c GROUP BY series_id""")
def convergence_time(spark, sf_dir):
    out = rel.convergence_time(filtered_errors(spark, sf_dir), threshold=60.0, window=10)
    return out.select("series_id", F.round("convergence_time", 6).alias("convergence_time"))


@query(f"WITH RECURSIVE {ERR} SELECT series_id, count(*) FILTER (WHERE error > 100.0) AS num_divergences, count(*) AS n_steps FROM e GROUP BY series_id")
def divergence_count(spark, sf_dir):
    return rel.divergences(filtered_errors(spark, sf_dir), 100.0)


@query("SELECT CAST(n AS INTEGER) AS n, round(n * power(1 - 2.0 / (9 * n) - 1.96 * sqrt(2.0 / (9 * n)), 3), 6) AS lower_bound, round(n * power(1 - 2.0 / (9 * n) + 1.96 * sqrt(2.0 / (9 * n)), 3), 6) AS upper_bound FROM (SELECT unnest(range(1, 41)) AS n)")
def chi2_bounds(spark, sf_dir):
    n = F.col("n").cast("double")
    half = F.sqrt(2.0 / (9 * n))
    mid = 1 - 2.0 / (9 * n)
    d = spark.range(1, 41).select(F.col("id").cast("int").alias("n"))
    return d.select("n", F.round(n * F.pow(mid - 1.96 * half, F.lit(3)), 6).alias("lower_bound"), F.round(n * F.pow(mid + 1.96 * half, F.lit(3)), 6).alias("upper_bound"))


# --- particles: each user's events, weighted by how near their value is to 100 -------------------

P_SQL = f"{EV}, raw AS (SELECT series_id, k AS i, y AS x, t, -0.5 * ((y - 100.0) / 50.0) * ((y - 100.0) / 50.0) AS log_w FROM ev), p AS (SELECT series_id, i, x, t, log_w - (m + ln(s)) AS log_w FROM (SELECT r.*, g.m, g.s FROM raw r JOIN (SELECT series_id, m, sum(exp(log_w - m)) AS s FROM (SELECT *, max(log_w) OVER (PARTITION BY series_id) AS m FROM raw) GROUP BY series_id, m) g USING (series_id)))"


def particles(spark, sf_dir) -> DataFrame:
    m = indexed(measurements(spark, sf_dir))
    z = (F.col("y") - 100.0) / 50.0
    return rel.normalized(m.select("series_id", F.col("k").alias("i"), F.col("y").alias("x"), "t", (-0.5 * z * z).alias("log_w")), ["series_id"])


@query(f"WITH {P_SQL} SELECT series_id, i, round(log_w, 6) AS log_w FROM p")
def lse_normalize(spark, sf_dir):
    return rd(particles(spark, sf_dir), ["series_id", "i"], ["log_w"])


@query(f"WITH {P_SQL} SELECT series_id, round(least(greatest(1.0 / sum(exp(2 * log_w)), 1.0), count(*)), 6) AS ess, count(*) AS n FROM p GROUP BY series_id")
def ess(spark, sf_dir):
    out = rel.effective_size(particles(spark, sf_dir), ["series_id"])
    return out.select("series_id", F.round("ess", 6).alias("ess"), "n")


UNIFORM = {"systematic": "CAST((series_id * 7919 + 13) % 10007 AS DOUBLE) / 10007.0", "stratified": "CAST((series_id * 7919 + i * 104729 + 13) % 10007 AS DOUBLE) / 10007.0"}


def parents_sql(scheme: str, name: str = "pa") -> str:
    return f"""cdf AS (SELECT series_id, i, sum(exp(log_w)) OVER (PARTITION BY series_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY series_id) AS n FROM p),
{name} AS (SELECT a.series_id, a.i, CAST(least(count(b.i), any_value(a.n) - 1) AS INTEGER) AS parent
       FROM (SELECT *, (i + {UNIFORM[scheme]}) / n AS u FROM cdf) a LEFT JOIN cdf b ON a.series_id = b.series_id AND b.cum < a.u GROUP BY a.series_id, a.i)"""


def parents(spark, sf_dir, scheme: str) -> DataFrame:
    return rel.resample(particles(spark, sf_dir), ["series_id"], F.expr(UNIFORM[scheme]), scheme)


@query(f"WITH {P_SQL}, {parents_sql('systematic')} SELECT series_id, i, parent FROM pa")
def systematic_resample(spark, sf_dir):
    return parents(spark, sf_dir, "systematic")


@query(f"WITH {P_SQL}, {parents_sql('stratified')} SELECT series_id, i, parent FROM pa")
def stratified_resample(spark, sf_dir):
    return parents(spark, sf_dir, "stratified")


@query(f"WITH {P_SQL}, {parents_sql('stratified')} SELECT pa.series_id, pa.i, pa.parent, p.x, round(-ln(count(*) OVER (PARTITION BY pa.series_id)), 6) AS log_w FROM pa JOIN p ON p.series_id = pa.series_id AND p.i = pa.parent")
def resample_gather(spark, sf_dir):
    p = particles(spark, sf_dir)
    out = rel.gather(p, rel.resample(p, ["series_id"], F.expr(UNIFORM["stratified"]), "stratified"), ["series_id"])
    return out.select("series_id", "i", "parent", "x", F.round("log_w", 6).alias("log_w"))


@query(f"WITH {P_SQL}, {parents_sql('systematic')} SELECT series_id, parent, count(*) AS offspring FROM pa GROUP BY series_id, parent")
def offspring_counts(spark, sf_dir):
    return parents(spark, sf_dir, "systematic").groupBy("series_id", "parent").agg(F.count(F.lit(1)).alias("offspring"))


@query(f"WITH {P_SQL} SELECT series_id, round(sum(exp(log_w) * x), 6) AS mean_x, round(sum(exp(log_w) * t) / 1e5, 6) AS mean_t, round(sum(exp(log_w) * x * x) - power(sum(exp(log_w) * x), 2), 4) AS cov_x_x FROM p GROUP BY series_id")
def weighted_mean_cov(spark, sf_dir):
    out = rel.moments(particles(spark, sf_dir), ["series_id"], ["x", "t"])
    return out.select("series_id", F.round("mean_x", 6).alias("mean_x"), F.round(F.col("mean_t") / 1e5, 6).alias("mean_t"), F.round("cov_x_x", 4).alias("cov_x_x"))


# ancestry: 16 places at 8 steps, parents by arithmetic
ANC_SQL = "edges AS (SELECT r_regionkey AS series_id, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST((i * 5 + k * 3 + r_regionkey) % 16 AS INTEGER) AS parent FROM region, (SELECT unnest(range(8)) AS k), (SELECT unnest(range(16)) AS i))"


def edges(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("series_id"))
    places = keys.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("series_id", "k", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    return places.withColumn("parent", ((F.col("i") * 5 + F.col("k") * 3 + F.col("series_id")) % 16).cast("int"))


BACKTRACK = "a1 AS (SELECT series_id, i, parent AS ancestor FROM edges WHERE k = 7), a2 AS (SELECT a.series_id, a.i, e.parent AS ancestor FROM a1 a JOIN edges e ON e.series_id = a.series_id AND e.i = a.ancestor AND e.k = 6), a3 AS (SELECT a.series_id, a.i, e.parent AS ancestor FROM a2 a JOIN edges e ON e.series_id = a.series_id AND e.i = a.ancestor AND e.k = 5)"


@query(f"WITH {ANC_SQL}, {BACKTRACK} SELECT * FROM a3")
def ancestry_backtrack(spark, sf_dir):
    return rel.backtrack(edges(spark, sf_dir), "series_id", last=7, lag=3)


@query(f"WITH {ANC_SQL}, {BACKTRACK} SELECT series_id, round(sum((1.0 + i % 3) * (ancestor * 1.5)) / sum(1.0 + i % 3), 6) AS x_smooth FROM a3 GROUP BY series_id")
def smoothed_particle_mean(spark, sf_dir):
    """Ancestors' states averaged with current weights."""
    path = rel.backtrack(edges(spark, sf_dir), "series_id", last=7, lag=3)
    w = F.lit(1.0) + F.col("i") % 3
    return path.groupBy("series_id").agg(F.round(F.sum(w * (F.col("ancestor") * 1.5)) / F.sum(w), 6).alias("x_smooth"))


# --- sigma points, densities, angles -------------------------------------------------------------

# prior of each user: mean and covariance of (value, hours since the start of the day)
PRIOR_SQL = "g AS (SELECT user_id AS series_id, avg(value) AS m0, avg(h) AS m1, avg(value * value) - avg(value) * avg(value) + 1.0 AS p00, avg(value * h) - avg(value) * avg(h) AS p01, avg(h * h) - avg(h) * avg(h) + 1.0 AS p11 FROM (SELECT user_id, value, hour(ts) * 1.0 AS h FROM events) GROUP BY user_id), l AS (SELECT *, sqrt(p00) AS l00, p01 / sqrt(p00) AS l10, sqrt(p11 - p01 * p01 / p00) AS l11 FROM g)"
SIGMA_SQL = "s AS (SELECT series_id, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 1.0 / 3 ELSE 1.0 / 6 END AS wm, CASE WHEN i = 0 THEN 7.0 / 3 ELSE 1.0 / 6 END AS wc, m0 + CASE i WHEN 1 THEN sqrt(3.0) * l00 WHEN 3 THEN -sqrt(3.0) * l00 ELSE 0.0 END AS x0, m1 + CASE i WHEN 1 THEN sqrt(3.0) * l10 WHEN 2 THEN sqrt(3.0) * l11 WHEN 3 THEN -sqrt(3.0) * l10 WHEN 4 THEN -sqrt(3.0) * l11 ELSE 0.0 END AS x1 FROM l, (SELECT unnest(range(5)) AS i))"


def sigma_rows(spark, sf_dir) -> DataFrame:
    """Sigma points of each user's two-state prior with alpha 1, beta 2, kappa 1: plus columns first."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("value").alias("a"), F.hour("ts").cast("double").alias("b"))
    g = e.groupBy("series_id").agg(F.avg("a").alias("m0"), F.avg("b").alias("m1"), (F.avg(F.col("a") * F.col("a")) - F.avg("a") * F.avg("a") + 1.0).alias("p00"), (F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b")).alias("p01"), (F.avg(F.col("b") * F.col("b")) - F.avg("b") * F.avg("b") + 1.0).alias("p11"))
    c = F.sqrt(F.lit(3.0))
    g = g.withColumns({"l00": F.sqrt("p00"), "l10": F.col("p01") / F.sqrt("p00"), "l11": F.sqrt(F.col("p11") - F.col("p01") * F.col("p01") / F.col("p00"))})
    sign = F.when(F.col("i") == 0, 0.0).when(F.col("i") <= 2, 1.0).otherwise(-1.0)
    col = (F.col("i") - 1) % 2
    d = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return d.select("series_id", "i", F.when(F.col("i") == 0, 1.0 / 3).otherwise(1.0 / 6).alias("wm"), F.when(F.col("i") == 0, 7.0 / 3).otherwise(1.0 / 6).alias("wc"), (F.col("m0") + sign * c * F.when(col == 0, F.col("l00")).otherwise(0.0)).alias("x0"), (F.col("m1") + sign * c * F.when(col == 0, F.col("l10")).otherwise(F.col("l11"))).alias("x1"))


@query(f"WITH {PRIOR_SQL}, {SIGMA_SQL} SELECT series_id, i, {rounded(['wm', 'wc', 'x0', 'x1'])} FROM s")
def sigma_points_2d(spark, sf_dir):
    return rd(sigma_rows(spark, sf_dir), ["series_id", "i"], ["wm", "wc", "x0", "x1"])


@query(f"WITH {PRIOR_SQL}, {SIGMA_SQL}, m AS (SELECT series_id, sum(wm * x0) AS a, sum(wm * x1) AS b FROM s GROUP BY series_id) SELECT s.series_id, round(any_value(m.a), 6) AS mean0, round(any_value(m.b), 6) AS mean1, round(sum(wc * (x0 - a) * (x0 - a)) + 0.5, 5) AS cov00, round(sum(wc * (x0 - a) * (x1 - b)), 5) AS cov01, round(sum(wc * (x1 - b) * (x1 - b)) + 0.5, 5) AS cov11 FROM s JOIN m ON s.series_id = m.series_id GROUP BY s.series_id")
def unscented_moments_2d(spark, sf_dir):
    """Weighted mean, and covariance plus noise, of the sigma points."""
    s = sigma_rows(spark, sf_dir)
    m = s.groupBy("series_id").agg(F.sum(F.col("wm") * F.col("x0")).alias("a"), F.sum(F.col("wm") * F.col("x1")).alias("b"))
    d = s.join(m, "series_id").withColumns({"u": F.col("x0") - F.col("a"), "v": F.col("x1") - F.col("b")})
    return d.groupBy("series_id").agg(F.round(F.first("a"), 6).alias("mean0"), F.round(F.first("b"), 6).alias("mean1"), F.round(F.sum(F.col("wc") * F.col("u") * F.col("u")) + 0.5, 5).alias("cov00"), F.round(F.sum(F.col("wc") * F.col("u") * F.col("v")), 5).alias("cov01"), F.round(F.sum(F.col("wc") * F.col("v") * F.col("v")) + 0.5, 5).alias("cov11"))


@query(f"SELECT event_id, round(-0.5 * ((value - 100.0) * (value - 100.0) / 400.0 + (hour(ts) - 12.0) * (hour(ts) - 12.0) / 36.0 + {math.log(400.0) + math.log(36.0)!r} + {2 * math.log(2 * math.pi)!r}), 6) AS logpdf FROM events")
def gaussian_logpdf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(rel.gaussian_logpdf([F.col("value"), F.hour("ts").cast("double")], [100.0, 12.0], [400.0, 36.0]), 6).alias("logpdf"))


T_CONST = math.lgamma(2.5) - math.lgamma(1.5) - 0.5 * (math.log(400.0) + math.log(36.0)) - math.log(3.0 * math.pi)


@query(f"SELECT event_id, round({T_CONST!r} - 2.5 * ln(1 + ((value - 100.0) * (value - 100.0) / 400.0 + (hour(ts) - 12.0) * (hour(ts) - 12.0) / 36.0) / 3.0), 6) AS logpdf FROM events")
def student_t_logpdf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(rel.student_t_logpdf([F.col("value"), F.hour("ts").cast("double")], [100.0, 12.0], [400.0, 36.0], 3.0), 6).alias("logpdf"))


@query("SELECT user_id, round(atan2(sum(value * sin(a)), sum(value * cos(a))), 6) AS mean_angle FROM (SELECT user_id, value, (hour(ts) * 60 + minute(ts)) * 2 * pi() / 1440 AS a FROM events) GROUP BY user_id")
def circular_mean(spark, sf_dir):
    """Value-weighted mean time of day of each user, as an angle."""
    e = table(spark, sf_dir, "events").withColumn("a", (F.hour("ts") * 60 + F.minute("ts")) * F.lit(2 * math.pi) / 1440)
    return e.groupBy("user_id").agg(F.round(rel.circular_mean(F.col("a"), F.col("value")), 6).alias("mean_angle"))


@query("SELECT event_id, round(value / 10 - 2 * pi() * round_even(value / 10 / (2 * pi()), 0), 6) AS wrapped FROM events")
def angle_wrap(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(rel.wrap_angle(F.col("value") / 10), 6).alias("wrapped"))


# --- models as projections ----------------------------------------------------------------------

def rk4_sql(names: list[str], derivs, dt: float, source: str, keep: list[str]) -> str:
    """Nested selects for one Runge-Kutta step; derivs(values, time offset) gives SQL expressions."""
    from driftline.plans.sqlfold import chain

    stages, at = [], names
    for k, (step, off) in enumerate(((None, 0.0), (dt / 2, dt / 2), (dt / 2, dt / 2), (dt, dt)), 1):
        if step is not None:
            mid = {f"{n}_m{k}": f"{n} + {step!r} * {n}_k{k - 1}" for n in names}
            stages.append(mid)
            at = list(mid)
        stages.append({f"{n}_k{k}": e for n, e in zip(names, derivs(at, off), strict=True)})
    out = ", ".join(f"round({n} + {dt!r} / 6 * ({n}_k1 + 2 * {n}_k2 + 2 * {n}_k3 + {n}_k4), 6) AS {n}_next" for n in names)
    return f"SELECT {', '.join(keep)}, {out} FROM {chain(source, stages)}"


VDP_IN = "(SELECT event_id, value / 250 - 1 AS a, sin(value) AS b, event_id % 400 / 100.0 AS t FROM events)"


@query(rk4_sql(["a", "b"], lambda x, off: [x[1], f"5.0 * (1 - {x[0]} * {x[0]}) * {x[1]} - {x[0]} + CASE WHEN fmod(t + {off!r}, 2.0) < 1 THEN 1.0 ELSE -1.0 END"], 0.02, VDP_IN, ["event_id"]))
def rk4_van_der_pol(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 250 - 1).alias("a"), F.sin("value").alias("b"), ((F.col("event_id") % 400) / F.lit(100.0)).alias("t"))
    out = models.rk4(models.van_der_pol, [F.col("a"), F.col("b")], F.col("t"), 0.02)
    return e.select("event_id", *[F.round(c, 6).alias(f"{n}_next") for n, c in zip("ab", out, strict=True)])


L63_IN = "(SELECT event_id, value / 25 - 10 AS a, 10 * sin(value) AS b, 20 + 10 * cos(value) AS c FROM events)"


@query(rk4_sql(["a", "b", "c"], lambda x, off: [f"10.0 * ({x[1]} - {x[0]})", f"{x[0]} * (28.0 - {x[2]}) - {x[1]}", f"{x[0]} * {x[1]} - {8.0 / 3.0!r} * {x[2]}"], 0.01, L63_IN, ["event_id"]))
def rk4_lorenz63(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 25 - 10).alias("a"), (10 * F.sin("value")).alias("b"), (20 + 10 * F.cos("value")).alias("c"))
    out = models.rk4(models.lorenz63, [F.col(c) for c in "abc"], F.lit(0.0), 0.01)
    return e.select("event_id", *[F.round(c, 6).alias(f"{n}_next") for n, c in zip("abc", out, strict=True)])


@query("SELECT event_id, round(a + 0.05 * b, 6) AS a_next, round(b + (-2.0 * sin(a) - 0.5 * b) * 0.05, 6) AS b_next FROM (SELECT event_id, value / 100 AS a, cos(value) AS b FROM events)")
def oscillator_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("a"), F.cos("value").alias("b"))
    out = models.oscillator_step([F.col("a"), F.col("b")], 0.05)
    return e.select("event_id", F.round(out[0], 6).alias("a_next"), F.round(out[1], 6).alias("b_next"))


@query("SELECT event_id, round(x + 0.1 * vx, 6) AS x_next, round(y + 0.1 * vy, 6) AS y_next, round(vx - 0.001 * sqrt(vx * vx + vy * vy) * vx * 0.1, 6) AS vx_next, round(vy - 0.001 * sqrt(vx * vx + vy * vy) * vy * 0.1 - 9.81 * 0.1, 6) AS vy_next FROM (SELECT event_id, value AS x, value / 2 AS y, 20 * sin(value) AS vx, 20 * cos(value) AS vy FROM events)")
def drag_ball_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y"), (20 * F.sin("value")).alias("vx"), (20 * F.cos("value")).alias("vy"))
    out = models.drag_ball_step([F.col(c) for c in ("x", "y", "vx", "vy")], 0.1)
    return e.select("event_id", *[F.round(c, 6).alias(f"{n}_next") for n, c in zip(("x", "y", "vx", "vy"), out, strict=True)])


@query("SELECT event_id, round(atan2(value * sin(value) - 100.0 * sin(0.1 * t), value * cos(value) - 100.0 * cos(0.1 * t)), 6) AS bearing FROM (SELECT *, CAST(event_id % 300 AS DOUBLE) / 10 AS t FROM events)")
def bearing_obs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", (F.col("event_id") % 300).cast("double") / 10)
    return e.select("event_id", F.round(models.bearing(F.col("value") * F.cos("value"), F.col("value") * F.sin("value"), F.col("t")), 6).alias("bearing"))


@query("SELECT event_id, round(r, 6) AS range_m, round(atan2(y, x), 6) AS azimuth, round(asin(least(greatest(z / greatest(r, 1e-6), -1.0), 1.0)), 6) AS elevation FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM (SELECT event_id, value * 10 AS x, 500 * sin(value) AS y, 300 * cos(value) AS z FROM events))")
def reentry_obs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 10).alias("x"), (500 * F.sin("value")).alias("y"), (300 * F.cos("value")).alias("z"))
    r, az, el = models.range_azimuth_elevation(F.col("x"), F.col("y"), F.col("z"))
    return e.select("event_id", F.round(r, 6).alias("range_m"), F.round(az, 6).alias("azimuth"), F.round(el, 6).alias("elevation"))


@query("WITH o AS (SELECT n_regionkey AS series_id, n_nationkey AS i, sin(n_nationkey) AS pos FROM nation) SELECT a.series_id, a.i, round(sum(0.5 * (b.pos - a.pos) + 0.3 * sin(b.pos - a.pos)), 6) AS force FROM o a JOIN o b ON a.series_id = b.series_id AND a.i <> b.i GROUP BY a.series_id, a.i")
def coupled_force(spark, sf_dir):
    """Pairwise coupling of the oscillators of one system (a system's oscillators are few by definition)."""
    o = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("series_id"), F.col("n_nationkey").cast("long").alias("i"), F.sin(F.col("n_nationkey").cast("double")).alias("pos"))
    b = o.select("series_id", F.col("i").alias("j"), F.col("pos").alias("other"))
    d = F.col("other") - F.col("pos")
    return o.join(b, "series_id").where("i <> j").groupBy("series_id", "i").agg(F.round(F.sum(models.COUPLED["coupling"] * d + models.COUPLED["nonlinearity"] * F.sin(d)), 6).alias("force"))


# --- joins, alignment, reports -------------------------------------------------------------------

@query(f"WITH {EV} SELECT a.series_id, CAST(a.k - 3 AS INTEGER) AS k, a.y AS smoothed, b.y AS truth FROM ev a JOIN ev b ON a.series_id = b.series_id AND b.k = a.k - 3")
def lag_alignment(spark, sf_dir):
    m = indexed(measurements(spark, sf_dir))
    return rel.lag_aligned(m.select("series_id", "k", F.col("y").alias("smoothed")), m.select("series_id", "k", F.col("y").alias("truth")), 3).select("series_id", F.col("k").cast("int").alias("k"), "smoothed", "truth")


@query("SELECT l.event_id, max_by(r.value, (r.ts, r.event_id)) AS last_value FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.ts < l.ts AND r.event_type = 'purchase' GROUP BY l.event_id")
def asof_state(spark, sf_dir):
    """The last purchase value strictly before each event of the user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return rel.as_of(e.select("user_id", "event_id", "ts"), right, "user_id", "ts", "last_value").select("event_id", "last_value")


@query(f"WITH RECURSIVE {ERR}, r AS (SELECT series_id, sqrt(sum(error * error) / count(*)) AS rmse FROM e GROUP BY series_id), base AS (SELECT user_id AS series_id, stddev_pop(value) AS baseline FROM events WHERE user_id % 5 <> 0 GROUP BY user_id) SELECT r.series_id, round(rmse, 6) AS rmse, round(baseline, 6) AS baseline, coalesce(rmse <= baseline * 1.005, false) AS passed FROM r LEFT JOIN base USING (series_id)")
def baseline_gate(spark, sf_dir):
    """Each metric row against its baseline; a row without one fails."""
    r = rel.rmse(filtered_errors(spark, sf_dir), ["y"], ["x_filt"], ["series_id"])
    base = table(spark, sf_dir, "events").where("user_id % 5 <> 0").groupBy(F.col("user_id").alias("series_id")).agg(F.stddev_pop("value").alias("baseline"))
    return r.join(base, "series_id", "left").select("series_id", F.round("rmse", 6).alias("rmse"), F.round("baseline", 6).alias("baseline"), F.coalesce(F.col("rmse") <= F.col("baseline") * 1.005, F.lit(False)).alias("passed"))


@query(f"WITH RECURSIVE {ERR} SELECT bucket, quarter, round(sqrt(sum(error * error) / count(*)), 6) AS rmse, count(*) AS n FROM (SELECT error, CAST(series_id % 4 AS INTEGER) AS bucket, CAST(k // 20 AS INTEGER) AS quarter FROM e) GROUP BY ROLLUP (bucket, quarter)")
def metrics_rollup(spark, sf_dir):
    e = filtered_errors(spark, sf_dir).select("error", (F.col("series_id") % 4).cast("int").alias("bucket"), F.floor(F.col("k") / 20).cast("int").alias("quarter"))
    return e.rollup("bucket", "quarter").agg(F.round(F.sqrt(F.sum(F.col("error") * F.col("error")) / F.count(F.lit(1))), 6).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {EV}, {kf_sql()}, {EKF_SQL.replace('f AS (', 'g AS (', 1).replace('FROM f p', 'FROM g p')}
SELECT a.series_id, round(a.r, 6) AS kf, round(b.r, 6) AS ekf, round(100 * (a.r - b.r) / a.r, 4) AS gain_pct
FROM (SELECT series_id, sqrt(avg(innovation * innovation)) AS r FROM f GROUP BY series_id) a JOIN (SELECT series_id, sqrt(avg(innovation * innovation)) AS r FROM g GROUP BY series_id) b USING (series_id)""")
def filter_pivot(spark, sf_dir):
    """Two filters' innovation RMSE side by side, with the improvement in percent."""
    m = measurements(spark, sf_dir)
    both = filters1d.kalman_1d(m).select("series_id", F.lit("kf").alias("filter"), "innovation").unionByName(filters1d.ekf_1d(m).select("series_id", F.lit("ekf").alias("filter"), "innovation"))
    p = both.groupBy("series_id").pivot("filter", ["kf", "ekf"]).agg(F.sqrt(F.avg(F.col("innovation") * F.col("innovation"))))
    return p.select("series_id", F.round("kf", 6).alias("kf"), F.round("ekf", 6).alias("ekf"), F.round(100 * (F.col("kf") - F.col("ekf")) / F.col("kf"), 4).alias("gain_pct"))


# --- filters of any size: batched numpy over series, no SQL form ---------------------------------

def walk_arrays(spark, sf_dir) -> DataFrame:
    return measurements(spark, sf_dir).select("series_id", "t", F.array("y").alias("y"))


def bent_model():
    """Position and velocity, with a slightly bent reading of the position."""
    from driftline.functions import catalog

    return catalog.NearlyLinear()


BENT_PRIOR = ([50.0, 0.0], [[400.0, 0.0], [0.0, 4.0]])


@query()
def ukf_series(spark, sf_dir):
    """Two-state unscented filter of each user's values."""
    from driftline.operators import kernels, series

    return series.filtered(walk_arrays(spark, sf_dir), lambda: kernels.Ukf(bent_model()), *BENT_PRIOR)


OWN_EV = """ev AS (
    SELECT user_id AS series_id, event_id, 0.0 AS t, value AS y, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS u,
           coalesce(c_acctbal / 100, 0.0) AS x0, CASE WHEN c_mktsegment = 'BUILDING' THEN 9.0 ELSE 1.0 END AS q,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS INTEGER) AS k
    FROM events LEFT JOIN customer ON c_custkey = user_id
    WHERE user_id IS NOT NULL AND ts IS NOT NULL
)"""
OWN_SQL = fold(
    {"x": "x0", "p": 100.0},
    [
        {"xp": "CASE WHEN k = 0 THEN prev_x ELSE prev_x + u END", "pp": "CASE WHEN k = 0 THEN prev_p ELSE prev_p + q END"},
        {"g": "pp / (pp + 25.0)", "innovation": "y - xp"},
        {"x": "xp + g * innovation", "p": "(1 - g) * pp", "nis": "innovation * innovation / (pp + 25.0)"},
    ],
    ["x", "p", "nis"],
)


@query(f"WITH RECURSIVE {OWN_EV}, {OWN_SQL} SELECT series_id, k, {rounded(['x', 'p', 'nis'])} FROM f")
def kf_by_series(spark, sf_dir):
    """Each user's own prior (from the balance), own dynamics (from the segment), and a control: purchases push the state."""
    from driftline.functions import catalog
    from driftline.operators import kernels, series

    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    rows = events.select(F.col("user_id").alias("series_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.array("value").alias("y"), F.array(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("u"))
    own = customer.select(F.col("c_custkey").alias("series_id"), F.array(F.coalesce(F.col("c_acctbal") / 100, F.lit(0.0))).alias("x0"), F.when(F.col("c_mktsegment") == "BUILDING", "fast").alias("model"))
    walk = lambda q: lambda: kernels.Ekf(catalog.Linear(np.eye(1), np.eye(1), q * np.eye(1), 25.0 * np.eye(1)))
    out = series.filtered(rows, {"slow": walk(1.0), "fast": walk(9.0)}, [0.0], [[100.0]], by_series=own, nu=1)
    return out.select("series_id", "k", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("p")[0], 6).alias("p"), F.round("nis", 6).alias("nis"))


@query()
def ekf_iterated_smoother_series(spark, sf_dir):
    """Full-interval extended smoother with one more pass."""
    from driftline.operators import kernels, series

    return series.filtered(walk_arrays(spark, sf_dir), lambda: kernels.Ekf(bent_model()), *BENT_PRIOR, smoother="full", rounds=1)


@query()
def srukf_smoothed_series(spark, sf_dir):
    """Square-root unscented filter with the gate, and its fixed-lag smoother."""
    from driftline.operators import kernels, series

    return series.filtered(walk_arrays(spark, sf_dir), lambda: kernels.SquareRootUkf(bent_model()), *BENT_PRIOR, smoother="fixed_lag", lag=10)


@query()
def particle_smoothed_series(spark, sf_dir):
    """Bootstrap particle filter of a walk with heavy-tailed readings, and its lagged means."""
    from driftline.operators import kernels, series

    class Walk:
        batched = True

        def propagate(self, x, t, u, rng):
            return x + 3.0 * rng.normal(size=x.shape)

        def loglik(self, y, x, t):
            return -2.0 * np.log1p((y[..., 0] - x[..., 0]) ** 2 / (3.0 * 625.0))

    def many(s, t, y):
        found = kernels.particle_filters(Walk(), lambda g, n: 100.0 + 100.0 * g.normal(size=(n, 1)), s, t, y, 200, lag=5, seed=11)
        return [(mean, smooth, size) for mean, _, smooth, size in found]

    return series.particle_filtered(walk_arrays(spark, sf_dir), many, 1, 5, together=True)


@query()
def rao_blackwell_turns(spark, sf_dir):
    """Rao-Blackwellised filter of simulated turns: one series for each region."""
    from driftline.functions import catalog
    from driftline.operators import kernels, series
    from driftline.sources import simulate

    keys = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("series_id"))

    def turns(batches):
        import pyarrow as pa

        for b in batches:
            for s in b.column(0).to_pylist():
                t, _, y = simulate.turn_series(60, seed=100 + s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), s)), pa.array(t), pa.array(list(y), pa.list_(pa.float64()))], names=["series_id", "t", "y"])

    def one(s, t, y):
        return kernels.rao_blackwell(catalog.TurnRate(), np.zeros(1), [0.0, 0, 10, 0], np.eye(4), s, t, y, 200, lag=10)

    return series.particle_filtered(keys.mapInArrow(turns, "series_id long, t double, y array<double>"), one, 2, 10)


@query()
def accuracy_suite(spark, sf_dir):
    """Thirteen rows of filter and problem against their baselines."""
    from driftline.plans import suite

    return suite.gate(spark, suite.suite(spark))


@query()
def simulated_trajectories(spark, sf_dir):
    """Truth and measurements of the four benchmark problems."""
    from driftline.sources import simulate

    out = None
    for name in simulate.PROBLEMS:
        part = simulate.simulated(spark, name).select(F.lit(name).alias("problem"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
