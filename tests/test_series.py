import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import catalog
from driftline.operators import filters1d, kernels, series
from driftline.operators import relational as rel
from driftline.plans import suite
from driftline.sources import csv, simulate
from driftline.sources.events import measurements

SF = "/root/testdata/sf0.001"
WALK = catalog.Linear(np.eye(1), np.eye(1), np.eye(1), 25 * np.eye(1))


def as_arrays(spark):
    return measurements(spark, SF).select("series_id", "t", F.array("y").alias("y"))


@pytest.mark.parametrize("name", ["ekf", "ukf", "srukf"])
def test_arrow_fold_is_the_catalyst_fold(spark, name):
    make = (lambda: kernels.SquareRootUkf(WALK, gate=1e12)) if name == "srukf" else (lambda: kernels.FILTERS[name](WALK))
    got = {(r.series_id, r.k): (r.x[0], r.p[0]) for r in series.filtered(as_arrays(spark), make, [0.0], [[100.0]]).collect()}
    want = {(r.series_id, r.k): (r.x_filt, r.p_filt) for r in filters1d.kalman_1d(measurements(spark, SF)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0], rel_tol=1e-5, abs_tol=1e-4) for k in want)


def test_smoothers_on_both_folds(spark):
    f = filters1d.kalman_1d(measurements(spark, SF))
    for kind, lag, twin in (("full", 0, filters1d.rts_1d(f)), ("fixed_lag", 4, filters1d.rts_1d(f, lag=4))):
        got = {(r.series_id, r.k): r.x_smooth[0] for r in series.filtered(as_arrays(spark), lambda: kernels.Ekf(WALK), [0.0], [[100.0]], kind, lag).collect() if r.x_smooth}
        want = {(r.series_id, r.k): r.x_smooth for r in twin.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-6) for k in want)


def test_unequal_series_nulls_and_empty(spark):
    rows = [(1, 0.0, [1.0]), (1, 1.0, None), (1, 2.0, [2.0]), (2, 5.0, [3.0]), (3, 1.0, [float("nan")]), (None, 0.0, [1.0]), (4, None, [1.0])]
    frame = spark.createDataFrame(rows, "series_id long, t double, y array<double>")
    out = {(r.series_id, r.k): r for r in series.filtered(frame, lambda: kernels.Ekf(WALK), [0.0], [[100.0]], "fixed_lag", 1).collect()}
    assert set(out) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    assert out[1, 1].nis is None and out[1, 1].p[0] == pytest.approx(out[1, 0].p[0] + 1) and out[3, 0].x == [0.0]
    assert out[1, 2].x_smooth is None and out[2, 0].x_smooth is None and out[1, 0].x_smooth is not None
    assert series.filtered(frame.where("false"), lambda: kernels.Ekf(WALK), [0.0], [[1.0]]).collect() == []


def test_priors_models_and_controls_by_series(spark):
    """Each series with its own prior, model and control is the scalar recursion with those."""

    makers = {"slow": lambda: kernels.Ekf(catalog.Linear(np.eye(1), np.eye(1), np.eye(1), 25 * np.eye(1))), "fast": lambda: kernels.Ekf(catalog.Linear(np.eye(1), np.eye(1), 9 * np.eye(1), np.eye(1)))}
    rng = np.random.default_rng(2)
    data = {s: [(float(k), float(v), float(c)) for k, (v, c) in enumerate(rng.normal(size=(5 + s, 2)))] for s in range(4)}
    frame = spark.createDataFrame([(s, t, [y], [c]) for s, rows in data.items() for t, y, c in rows], "series_id long, t double, y array<double>, u array<double>")
    own = spark.createDataFrame([(0, [3.0], [4.0], "fast"), (1, None, None, "fast"), (2, [-1.0], [2.0], None)], "series_id long, x0 array<double>, p0 array<double>, model string")
    settings = {0: (3, 4, 9, 1), 1: (0, 100, 9, 1), 2: (-1, 2, 1, 25), 3: (0, 100, 1, 25)}
    for smoother in (None, "fixed_lag", "full"):
        got = {(r.series_id, r.k): (r.x[0], r.p[0]) for r in series.filtered(frame, makers, [0.0], [[100.0]], smoother, 2, by_series=own, nu=1).collect()}
        assert len(got) == sum(map(len, data.values()))
        for s, (x, p, q, r) in settings.items():
            for k, (_, y, c) in enumerate(data[s]):
                if k:
                    x, p = x + c, p + q
                g = p / (p + r)
                x, p = x + g * (y - x), (1 - g) * p
                assert got[s, k] == pytest.approx((x, p))


def test_batches_are_bounded_by_their_padding(monkeypatch):
    """A long series is no padding for short ones; a series that record batches split is whole again."""
    import pyarrow as pa

    sizes = {1: 3, 2: 50, 3: 2, 4: 2, 5: 1, 6: 30, 7: 1}
    ids = np.repeat(list(sizes), list(sizes.values()))
    whole = pa.table({"series_id": ids, "t": np.arange(len(ids), dtype=float), "y": [[float(v)] if v % 3 else None for v in range(len(ids))]})
    parts = list(series.whole_series(iter(whole.to_batches(max_chunksize=7)), 1, rows=40))
    assert {s.id: len(s.t) for part in parts for s in part} == sizes
    assert all(len(part) == 1 or len(part) * max(len(s.t) for s in part) <= 40 for part in parts) and any(len(part) > 1 for part in parts)
    t = np.concatenate([s.t for part in parts for s in part])
    y = np.concatenate([s.y[:, 0] for part in parts for s in part])
    assert (t == np.arange(len(ids))).all() and (np.isnan(y) == (t % 3 == 0)).all()


def test_gated_steps_are_marked(spark):
    frame = spark.createDataFrame([(1, float(k), [v]) for k, v in enumerate([0.0, 1.0, 500.0, 0.0])], "series_id long, t double, y array<double>")
    out = series.filtered(frame, lambda: kernels.SquareRootUkf(WALK, gate=9.0), [0.0], [[100.0]]).collect()
    assert [r.gated for r in sorted(out, key=lambda r: r.k)] == [False, False, True, False]


def test_particle_filters_are_the_kalman_filter_on_a_walk(spark):
    class Walk:
        def propagate(self, x, t, u, rng):
            return x + rng.normal(size=x.shape)

        def loglik(self, y, x, t):
            return -0.5 * (y[0] - x[..., 0]) ** 2 / 25

    rng = np.random.default_rng(0)
    rows = [(s, float(k), [float(v)]) for s in range(3) for k, v in enumerate(np.cumsum(rng.normal(size=40)) + 5 * rng.normal(size=40))]
    frame = spark.createDataFrame(rows, "series_id long, t double, y array<double>")
    prior = lambda g, n: 10 * g.normal(size=(n, 1))

    def one(s, t, y):
        mean, _, smooth, size = kernels.particle_filter(Walk(), prior, s, t, y, 4000, lag=3, seed=1)
        return mean, smooth, size

    got = {(r.series_id, r.k): r.x[0] for r in series.particle_filtered(frame, one, 1, 3).collect()}
    want = {(r.series_id, r.k): r.x[0] for r in series.filtered(frame, lambda: kernels.Ekf(WALK), [0.0], [[100.0]], first="predict").collect()}
    assert np.sqrt(np.mean([(got[k] - want[k]) ** 2 for k in want])) < 0.5


def test_suite_rows_and_gate(spark, tmp_path):
    rows = suite.metrics(spark, "SRUKF+Smoother", "ReentryVehicle6D").unionByName(suite.metrics(spark, "UKF", "VanDerPol2D"))
    passed = suite.gate(spark, rows).collect()
    assert len(passed) == 2 and all(r.passed for r in passed)
    assert [r.Convergence_Time is None for r in sorted(passed, key=lambda r: r.Problem)] == [True, False]
    csv.write_metrics(rows, str(tmp_path / "m"))
    back = csv.read_metrics(spark, str(tmp_path / "m")).collect()
    assert {r.Filter for r in back} == {"SRUKF+Smoother", "UKF"} and any(r.Convergence_Time is None for r in back)


def test_trajectory_csv(spark, tmp_path):
    rows = suite.filtered_problem(spark, "SRUKF+Smoother", "BearingOnly4D")
    stored = rows.select("series_id", "k", "t", "truth", "x", F.col("x_smooth").alias("now"))
    from pyspark.sql import Window

    stored = stored.withColumn("smooth", F.lag("now", 30).over(Window.partitionBy("series_id").orderBy("k")))
    csv.write_trajectories(stored, str(tmp_path / "t"), 4, 30)
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert back.columns[:5] == ["time", "true_x0", "true_x1", "true_x2", "true_x3"] and back.count() == 300
    assert back.where("smooth_x0 is null").count() == 30


def test_dead_particles_and_nan_metrics(spark):
    p = spark.createDataFrame([(1, 0, float("-inf")), (1, 1, 0.0), (2, 0, float("-inf")), (2, 1, float("nan"))], "series_id long, i int, log_w double")
    got = {(r.series_id, r.i): r.log_w for r in rel.normalized(p, ["series_id"]).collect()}
    assert got[1, 1] == 0 and got[1, 0] == float("-inf") and got[2, 0] == pytest.approx(-math.log(2))
    e = spark.createDataFrame([(1, k, float(k), float("nan") if k == 3 else 0.1) for k in range(5)], "series_id long, k int, t double, error double")
    assert rel.divergences(e, 1.0).first().num_divergences == 1
    assert rel.convergence_time(e, 1.0, window=3).first().convergence_time is None


def test_stream_is_the_batch(spark, tmp_path):
    """However the input is cut, and out of order within the watermark."""
    from driftline.streaming import processor

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 4").orderBy("ts").collect()
    source = str(tmp_path / "in")
    schema = "series_id long, ts timestamp, t double, y array<double>"
    rows = [(r.user_id, r.ts, r.ts.timestamp() - 1704067200.0, [r.value]) for r in events]
    # missing measurements, and rows of one time
    rows[20:22] = [(*rows[20][:3], None), (*rows[21][:3], [None])]
    rows[40:40] = [(*rows[40][:3], [7.0]), (*rows[40][:3], None)]
    want = {(r.series_id, r.k): (r.x[0], r.x_smooth and r.x_smooth[0]) for r in series.filtered(spark.createDataFrame(rows, schema), lambda: kernels.Ekf(WALK), [0.0], [[100.0]], "fixed_lag", 2).collect()}
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60][::-1], schema).coalesce(1).write.mode("append").parquet(source)
    import datetime

    end = rows[-1][1] + datetime.timedelta(days=400)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = processor.filtered_stream(stream, lambda: kernels.Ekf(WALK), [0.0], [[100.0]], "30 days", lag=2)
    q = out.writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    # rows of a far later time move the watermark past all others
    spark.createDataFrame([(99, end, 1e9, [0.0])], schema).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = {(r.series_id, r.k): (r.x[0], r.x_smooth and r.x_smooth[0]) for r in spark.sql("select * from online").collect() if r.series_id != 99}
    assert got.keys() == want.keys()
    for k, (x, _) in want.items():
        assert got[k][0] == pytest.approx(x, rel=1e-9)
    for (s, k), (_, smooth) in want.items():
        if smooth is not None:
            assert got[s, k + 2][1] == pytest.approx(smooth, rel=1e-9)


def test_pre_aggregation(spark):
    from driftline.streaming import processor

    e = spark.read.parquet(f"{SF}/events.parquet")
    assert processor.windowed(e, "1 day", "1 day").agg(F.sum("n")).first()[0] == e.count()
    assert processor.sessions(e, "1 day", "2 hours").agg(F.sum("n")).first()[0] == e.count()
    assert processor.windowed(e, "1 day", "2 days", "1 day").agg(F.sum("n")).first()[0] == 2 * e.count()
