"""Series of unlike lengths go through the full smoother and the particle filter together, with each one's own results."""

import numpy as np

from driftline.operators import kernels, series


def walks(n=60):
    rng = np.random.default_rng(2)
    size = rng.integers(1, 40, n)
    t = [np.arange(k) * 1.0 for k in size]
    y = [100 + np.cumsum(3 * rng.normal(size=(k, 1)), 0) + 25 * rng.normal(size=(k, 1)) for k in size]
    y[3][0] = np.nan
    return t, y


class Walk:
    calls = 0

    def propagate(self, x, t, u, rng):
        return x + 3.0 * rng.normal(size=x.shape)

    def loglik(self, y, x, t):
        Walk.calls += 1
        return -2.0 * np.log1p((y[..., 0] - x[..., 0]) ** 2 / 1875.0)


class Together(Walk):
    batched = True


def prior(rng, n):
    return 100.0 + 100.0 * rng.normal(size=(n, 1))


def test_particles_of_many_series(monkeypatch):
    t, y = walks()
    alone = [kernels.particle_filter(Walk(), prior, i, t[i], y[i], 50, lag=5, seed=11) for i in range(len(t))]
    Walk.calls = 0
    both = kernels.particle_filters(Together(), prior, list(range(len(t))), t, y, 50, lag=5, seed=11)
    assert Walk.calls <= 40
    monkeypatch.setattr(kernels, "AT_ONCE", 50 * 7)
    parts = kernels.particle_filters(Together(), prior, list(range(len(t))), t, y, 50, lag=5, seed=11)
    for a, b, c in zip(alone, both, parts, strict=True):
        assert all(np.array_equal(u, v) and np.array_equal(u, w) for u, v, w in zip(a, b, c, strict=True))


def test_generators_set_anew():
    steps = kernels._Steps(5, 9)
    for k in (0, 3, 1):
        want, got = kernels.generator(5, 9, k), steps.at(k)
        assert np.array_equal(want.normal(size=7), got.normal(size=7)) and np.array_equal(want.random(5), got.random(5))


def test_full_smoother_of_unlike_lengths(spark, monkeypatch):
    from driftline.plans.registry import BENT_PRIOR, bent_model

    t, y = walks(40)
    frame = spark.createDataFrame([(i, float(a), [None if np.isnan(v) else float(v) for v in b]) for i in range(40) for a, b in zip(t[i], y[i])], "series_id long, t double, y array<double>").coalesce(1)
    make = lambda: kernels.Ekf(bent_model())
    many = {(r.series_id, r.k): r for r in series.filtered(frame, make, *BENT_PRIOR, smoother="full", rounds=1).collect()}
    assert len(many) == sum(map(len, t))
    for i in range(40):
        r, xs, ps = kernels.iterated(make, *map(np.asarray, BENT_PRIOR), t[i][None], y[i][None], 1)
        for k in range(len(t[i])):
            got = many[i, k]
            assert np.allclose(got.x_smooth, xs[k, 0], rtol=1e-12, atol=1e-12) and np.allclose(got.p_smooth, ps[k, 0].ravel(), rtol=1e-12, atol=1e-12)
            assert np.allclose(got.x, r["x"][k, 0], rtol=1e-12) and got.status == r["status"][k, 0]


def test_unlike_lengths_are_one_batch(monkeypatch):
    from driftline.plans.registry import BENT_PRIOR, bent_model

    runs = []
    run = kernels.run
    monkeypatch.setattr(kernels, "run", lambda *a: runs.append(a[3].shape) or run(*a))
    live = np.array([[True] * 5, [True] * 3 + [False] * 2])
    y = np.where(live[..., None], np.arange(10.0).reshape(2, 5, 1) + 95, np.nan)
    t = np.tile(np.arange(5.0), (2, 1))
    make = lambda: kernels.Ekf(bent_model())
    _, xs, ps = kernels.iterated(make, *map(np.asarray, BENT_PRIOR), t, y, 1, "update", live)
    assert runs == [(2, 5), (2, 5)]
    _, alone, own = kernels.iterated(make, *map(np.asarray, BENT_PRIOR), t[1:, :3], y[1:, :3], 1)
    assert np.allclose(xs[:3, 1], alone[:, 0], rtol=1e-12) and np.allclose(ps[:3, 1], own[:, 0], rtol=1e-12)


def test_one_singular_matrix_costs_the_others_nothing():
    a = np.stack([np.eye(2), np.zeros((2, 2)), 3 * np.eye(2)])
    g = kernels.gain(np.tile(np.eye(2), (3, 1, 1)), a)
    assert np.array_equal(g[0], np.eye(2)) and np.array_equal(g[1], np.zeros((2, 2))) and np.allclose(g[2], np.eye(2) / 3)
