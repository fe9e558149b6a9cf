"""Scalar and two-state recursive estimators as Catalyst folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.fold import first, let, series_fold


def _joseph(pp: Column, g: Column, h, r: float) -> Column:
    return (1 - g * h) * (1 - g * h) * pp + g * g * r


def kalman_1d(rows: DataFrame, q: float = 1.0, r: float = 25.0, x0: float = 0.0, p0: float = 100.0, a: float = 1.0, bias: float = 0.0, h: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Linear Kalman filter with affine observation; Joseph update. The first row only updates."""

    def step(acc: Column, m: Column) -> Column:
        xp = F.when(first(acc), acc["x"]).otherwise(a * acc["x"] + bias)
        pp = F.when(first(acc), acc["p"]).otherwise(a * a * acc["p"] + q)
        pred = F.struct(xp.alias("x"), pp.alias("p"))
        return let(pred, lambda z: let(F.struct((m["y"] - (h * z["x"] + offset)).alias("nu"), (h * h * z["p"] + r).alias("s")), lambda w: let(z["p"] * h / w["s"], lambda g: F.struct((z["x"] + g * w["nu"]).alias("x"), _joseph(z["p"], g, h, r).alias("p"), z["x"].alias("x_pred"), z["p"].alias("p_pred"), w["nu"].alias("innovation"), (w["nu"] * w["nu"] / w["s"]).alias("nis")))))

    out = series_fold(rows, {"x": x0, "p": p0}, step, ["x", "p", "x_pred", "p_pred", "innovation", "nis"], ["event_id", "t", "y"])
    return out.withColumnsRenamed({"x": "x_filt", "p": "p_filt"})


def kalman_cv(rows: DataFrame, q: float = 1e-9, r: float = 25.0, scale: float = 3600.0) -> DataFrame:
    """Constant velocity over irregular times (in units of ``scale`` seconds): five state numbers and the last time."""

    def step(acc: Column, m: Column) -> Column:
        dt = F.when(first(acc), F.lit(0.0)).otherwise((m["t"] - acc["t0"]) / scale)
        return let(dt, lambda d: let(
            F.struct(
                (acc["x"] + d * acc["v"]).alias("x"), acc["v"].alias("v"),
                (acc["pxx"] + 2 * d * acc["pxv"] + d * d * acc["pvv"] + q * d * d * d / 3).alias("pxx"), (acc["pxv"] + d * acc["pvv"] + q * d * d / 2).alias("pxv"), (acc["pvv"] + q * d).alias("pvv"),
            ),
            lambda z: let(F.struct((z["pxx"] / (z["pxx"] + r)).alias("a"), (z["pxv"] / (z["pxx"] + r)).alias("b"), (m["y"] - z["x"]).alias("nu")), lambda g: F.struct(
                (z["x"] + g["a"] * g["nu"]).alias("x"), (z["v"] + g["b"] * g["nu"]).alias("v"),
                ((1 - g["a"]) * z["pxx"]).alias("pxx"), ((1 - g["a"]) * z["pxv"]).alias("pxv"), (z["pvv"] - g["b"] * z["pxv"]).alias("pvv"), m["t"].alias("t0"),
                g["nu"].alias("innovation"),
            )),
        ))

    return series_fold(rows, {"x": 0.0, "v": 0.0, "pxx": 100.0, "pxv": 0.0, "pvv": 1.0, "t0": 0.0}, step, ["x", "v", "pxx", "pxv", "pvv", "innovation"], ["event_id"])


def ekf_1d(rows: DataFrame, c: float = 0.004, q: float = 1.0, r: float = 25.0, x0: float = 50.0, p0: float = 400.0) -> DataFrame:
    """Extended filter of a random walk seen through h(x) = x (1 + c x)."""

    def step(acc: Column, m: Column) -> Column:
        pp = F.when(first(acc), acc["p"]).otherwise(acc["p"] + q)
        return let(F.struct(acc["x"].alias("x"), pp.alias("p"), (1 + 2 * c * acc["x"]).alias("h")), lambda z: let(z["h"] * z["h"] * z["p"] + r, lambda s: let(F.struct((z["p"] * z["h"] / s).alias("g"), (m["y"] - z["x"] * (1 + c * z["x"])).alias("nu")), lambda w: F.struct((z["x"] + w["g"] * w["nu"]).alias("x"), _joseph(z["p"], w["g"], z["h"], r).alias("p"), w["nu"].alias("innovation"), (w["nu"] * w["nu"] / s).alias("nis")))))

    return series_fold(rows, {"x": x0, "p": p0}, step, ["x", "p", "innovation", "nis"], ["event_id"])


def ukf_1d(rows: DataFrame, c: float = 0.004, q: float = 1.0, r: float = 25.0, x0: float = 50.0, p0: float = 400.0) -> DataFrame:
    """Unscented filter of the same model. With the default scaling the guard makes lambda zero: Wm0 = 0, Wc0 = 3 - alpha^2, w = 1/2."""
    wc0 = 1 - 1e-6 + 2.0

    def step(acc: Column, m: Column) -> Column:
        pp = F.when(first(acc), acc["p"]).otherwise(acc["p"] + q)
        h = lambda x: x * (1 + c * x)
        return let(F.struct(acc["x"].alias("x"), pp.alias("p"), F.sqrt(pp).alias("l")), lambda z: let(
            F.struct(h(z["x"]).alias("y0"), h(z["x"] + z["l"]).alias("y1"), h(z["x"] - z["l"]).alias("y2")), lambda y: let((y["y1"] + y["y2"]) / 2, lambda mean: let(
                F.struct((wc0 * (y["y0"] - mean) * (y["y0"] - mean) + ((y["y1"] - mean) * (y["y1"] - mean) + (y["y2"] - mean) * (y["y2"] - mean)) / 2 + r).alias("s"), (z["l"] * (y["y1"] - y["y2"]) / 2).alias("pxy"), (m["y"] - mean).alias("nu")), lambda w: let(
                    w["pxy"] / w["s"], lambda g: F.struct((z["x"] + g * w["nu"]).alias("x"), (z["p"] - 2 * g * w["pxy"] + g * g * w["s"]).alias("p"), w["nu"].alias("innovation"), (w["nu"] * w["nu"] / w["s"]).alias("nis")))))))

    return series_fold(rows, {"x": x0, "p": p0}, step, ["x", "p", "innovation", "nis"], ["event_id"])


def srukf_1d_gated(rows: DataFrame, q: float = 1.0, r: float = 25.0, x0: float = 50.0, s0: float = 10.0, gate: float = 4.0) -> DataFrame:
    """Square-root unscented filter of a linear walk with a soft innovation gate; state is the factor S.

    Beyond the gate the update is scaled by sqrt(gate / NIS); the downdate uses 2s - s^2.
    """

    def step(acc: Column, m: Column) -> Column:
        sp = F.when(first(acc), acc["s"]).otherwise(F.sqrt(acc["s"] * acc["s"] + q))
        return let(F.struct(acc["x"].alias("x"), sp.alias("s")), lambda z: let(F.struct((z["s"] * z["s"] + r).alias("pyy"), (m["y"] - z["x"]).alias("nu")), lambda w: let(
            F.struct((z["s"] * z["s"] / w["pyy"]).alias("g"), (w["nu"] * w["nu"] / w["pyy"]).alias("nis")), lambda u: let(
                F.when(u["nis"] > gate, F.sqrt(F.lit(gate) / F.greatest(u["nis"], F.lit(gate)))).otherwise(F.lit(1.0)), lambda f: F.struct(
                    (z["x"] + f * u["g"] * w["nu"]).alias("x"), F.sqrt(z["s"] * z["s"] - (2 * f - f * f) * u["g"] * u["g"] * w["pyy"]).alias("s"), u["nis"].alias("nis"), f.alias("scale"), F.when(u["nis"] > gate, F.lit(1.0)).otherwise(F.lit(0.0)).alias("gated"))))))

    return series_fold(rows, {"x": x0, "s": s0}, step, ["x", "s", "nis", "scale", "gated"], ["event_id"])


def rts_1d(filtered: DataFrame, q: float = 1.0, lag: int | None = None) -> DataFrame:
    """Rauch-Tung-Striebel smoothing of a scalar walk from its filter's rows (series_id, k, x_filt, p_filt).

    With ``lag`` each row k is smoothed by the rows up to k + lag only and rows that lack them are left
    out (no value exists yet); without it by all rows of the series.
    """
    from pyspark.sql import Window

    item = F.struct("k", F.col("x_filt").alias("x"), F.col("p_filt").alias("p"))
    zero = lambda m: F.struct(m["x"].alias("x"), m["p"].alias("p"))

    def back(acc: Column, m: Column) -> Column:
        return let(m["p"] / (m["p"] + q), lambda g: F.struct((m["x"] + g * (acc["x"] - m["x"])).alias("x"), (m["p"] + g * g * (acc["p"] - m["p"] - q)).alias("p")))

    if lag is not None:
        w = Window.partitionBy("series_id").orderBy("k").rowsBetween(-lag, 0)
        windows = filtered.select("series_id", "k", F.reverse(F.collect_list(item).over(w)).alias("w")).where(F.size("w") == lag + 1)
        s = F.aggregate(F.slice("w", 2, lag), zero(F.col("w")[0]), back)
        return windows.select("series_id", (F.col("k") - lag).cast("int").alias("k"), s.alias("s")).select("series_id", "k", F.col("s.x").alias("x_smooth"), F.col("s.p").alias("p_smooth"))
    gathered = filtered.groupBy("series_id").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("m"))
    kind = "array<struct<k:int,x:double,p:double>>"

    start = F.array(F.struct(F.col("m")[0]["k"].alias("k"), F.col("m")[0]["x"].alias("x"), F.col("m")[0]["p"].alias("p"))).cast(kind)
    fold = lambda acc, m: F.concat(acc, F.array(let(back(F.element_at(acc, -1), m), lambda v: F.struct(m["k"].alias("k"), v["x"].alias("x"), v["p"].alias("p")))))
    out = gathered.select("series_id", F.aggregate(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1))), start, fold).alias("out"))
    return out.select("series_id", F.inline("out")).select("series_id", "k", F.col("x").alias("x_smooth"), F.col("p").alias("p_smooth"))
