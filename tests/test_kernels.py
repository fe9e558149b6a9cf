import numpy as np
import pytest

from driftline.functions import catalog
from driftline.operators import kernels as K
from driftline.sources import simulate as S

LINE = (np.array([-40.0 + 20.0, 3.0]), np.diag([400.0, 4.0]))


def rms(e):
    return np.sqrt((e**2).sum(-1).mean())


def once(name, problem, scaling=None, **kw):
    p = S.PROBLEMS[problem]
    t, x, y = S.trajectory(p)
    r = K.run(K.FILTERS[name](p.model, **kw), np.array(p.x0, float), np.diag(np.array(p.p0, float)), t[None], y[None])
    return p, t, x, r


#: Published RMSE of filter and fixed-lag smoother.
GOLDEN = {
    ("ukf", "CoupledOscillators10D"): (1.45655, 1.14768), ("srukf", "CoupledOscillators10D"): (1.45655, 1.14768), ("ukf", "VanDerPol2D"): (0.468888, None), ("srukf", "VanDerPol2D"): (0.467096, 0.430381),
    ("ukf", "BearingOnly4D"): (63.4902, None), ("srukf", "BearingOnly4D"): (63.8392, 51.6818), ("ukf", "ReentryVehicle6D"): (366.868, None), ("srukf", "ReentryVehicle6D"): (367.115, 236.251),
}


@pytest.mark.parametrize("name,problem", sorted(GOLDEN))
def test_golden(name, problem):
    p, t, x, r = once(name, problem)
    want, smooth = GOLDEN[name, problem]
    assert abs(rms(r["x"][:, 0] - x) / want - 1) < 0.005
    if smooth:
        xs, _ = K.fixed_lag(r, p.lag)
        assert abs(rms(xs[:, 0] - x[: len(xs)]) / smooth - 1) < 0.005
    assert (np.linalg.norm(r["x"][:, 0] - x, axis=1) <= p.diverged).all()


def test_linear_filters_agree_with_each_other():
    rng = np.random.default_rng(0)
    m = catalog.Linear(np.array([[1, 0.1], [0, 1]]), np.array([[1.0, 0]]), 0.01 * np.eye(2), np.array([[0.25]]))
    y = rng.normal(size=(3, 50, 1))
    t = np.tile(np.arange(50.0), (3, 1))
    runs = [K.run(f, np.zeros(2), np.eye(2), t, y) for f in (K.Ekf(m), K.Ukf(m), K.SquareRootUkf(m, gate=1e9))]
    for r in runs[1:]:
        assert np.allclose(r["x"], runs[0]["x"], atol=1e-6) and np.allclose(r["p"], runs[0]["p"], atol=1e-6)
        assert np.allclose(K.rts(r)[0], K.rts(runs[0])[0], atol=1e-5)
    xs, _ = K.fixed_lag(runs[0], 49)
    assert np.allclose(xs[0], K.rts(runs[0])[0][0])


@pytest.mark.parametrize("name", ["ekf", "ukf", "srukf"])
def test_full_interval_smoothing(name):
    t, x, y = S.line_series()
    m = catalog.NearlyLinear()
    errors = []
    for seed in range(10):
        t, x, y = S.line_series(seed=seed)
        r, xs, ps = K.iterated(lambda: K.FILTERS[name](m), *LINE, t[None], y[None], 0, first="predict")
        _, xi, _ = K.iterated(lambda: K.FILTERS[name](m), *LINE, t[None], y[None], 3, first="predict")
        errors.append([rms(r["x"][:, 0] - x), rms(xs[:, 0] - x), rms(xi[:, 0] - x)])
        assert np.linalg.eigvalsh(ps).min() > -1e-4
        assert np.trace(ps, axis1=-2, axis2=-1).sum() < np.trace(r["p"], axis1=-2, axis2=-1).sum()
    filt, smooth, again = np.mean(errors, 0)
    assert smooth < filt and smooth < 1.0 and again < smooth + 0.2


def test_demos():
    t, x, y = S.oscillator_series()
    r = K.run(K.Ekf(catalog.Oscillator()), np.zeros(2), np.eye(2), t[None], y[None], first="predict")
    xs, _ = K.fixed_lag(r, 10)
    assert rms(r["x"][30:, 0] - x[30:]) < 0.12 and rms(xs[30:, 0] - x[30 : len(xs)]) < rms(r["x"][30:, 0] - x[30:])
    t, x, y = S.drag_ball_series()
    r = K.run(K.Ukf(catalog.DragBall()), np.array([5.0, 95, 12, 0]), np.diag([10.0, 10, 5, 5]), t[None], y[None], first="skip")
    xs, _ = K.fixed_lag(r, 10)
    assert rms((r["x"][10:, 0] - x[10:])[:, :2]) < 0.35 and rms((xs[:, 0] - x[: len(xs)])[:, :2]) < rms((r["x"][:, 0] - x)[:, :2])


def test_angle_wrap_and_gate():
    m = catalog.Linear(np.eye(1), np.eye(1), 1e-6 * np.eye(1), 0.04 * np.eye(1), angular_obs=(0,))
    r = K.run(K.SquareRootUkf(m), np.array([3.0]), np.array([[0.25]]), np.zeros((1, 1)), np.array([[[-3.0]]]))
    assert abs(r["x"][0, 0, 0]) > 2.5 and 0 <= r["nis"][0, 0] < 25
    m = catalog.Linear(np.eye(1), np.eye(1), np.eye(1), np.eye(1))
    far = np.full((1, 1, 1), 1000.0)
    assert K.run(K.SquareRootUkf(m, reject=True), np.zeros(1), np.eye(1), np.zeros((1, 1)), far)["x"][0, 0, 0] == 0
    assert 0 < K.run(K.SquareRootUkf(m), np.zeros(1), np.eye(1), np.zeros((1, 1)), far)["x"][0, 0, 0] < 20


@pytest.mark.parametrize("p0", [[[np.nan, 0], [0, 1]], [[np.inf, 0], [0, 1]], [[1, 0.5], [0, 1]], [[1, 2], [2, 1]]])
def test_bad_prior_is_refused(p0):
    with pytest.raises(ValueError):
        K.SquareRootUkf(catalog.NearlyLinear()).start(np.zeros((1, 2)), np.array([p0], float))


def test_contraction_and_rank_deficient_prior():
    m = catalog.Linear(np.eye(2), np.eye(2), 1e-4 * np.eye(2), 1e-2 * np.eye(2))
    r = K.run(K.Ukf(m), np.zeros(2), np.ones((2, 2)), np.zeros((1, 10)), np.tile([0.1, -0.1], (1, 10, 1)))
    assert np.isfinite(r["p"]).all() and np.linalg.eigvalsh(r["p"]).min() > -1e-9
    r = K.run(K.Ukf(m), np.zeros(2), 10 * np.eye(2), np.zeros((1, 20)), np.zeros((1, 20, 2)))
    trace = np.trace(r["p"][:, 0], axis1=-2, axis2=-1)
    assert (np.diff(trace) < 1e-3).all() and trace[-1] < 1


def test_bad_measurement_keeps_the_prior():
    m = catalog.Linear(np.eye(1), np.eye(1), np.eye(1), np.eye(1))
    y = np.array([[[1.0], [np.inf], [np.nan], [1.0]]])
    r = K.run(K.Ekf(m), np.zeros(1), np.eye(1), np.arange(4.0)[None], y)
    assert r["status"][:, 0].tolist() == [0, 1, 0, 0] and np.isfinite(r["x"]).all()


@pytest.mark.parametrize("scheme", ["systematic", "stratified"])
def test_resampling(scheme):
    w = np.tile([0.1, 0.2, 0.3, 0.4], (4000, 1))
    parents = K.resample(w, np.random.default_rng(0), scheme)
    counts = np.stack([(parents == j).sum(1) for j in range(4)], 1)
    assert np.allclose(counts.mean(0) / 4, w[0], atol=0.02)
    if scheme == "systematic":
        assert ((counts == np.floor(4 * w)) | (counts == np.ceil(4 * w - 1e-12))).all()


def test_log_weights():
    lw = K.log_normalize(np.array([[-1000.0, -1001, -np.inf], [-np.inf] * 3, [np.nan, 0, 0]]))
    assert np.allclose(np.exp(lw).sum(1), 1) and np.exp(lw[2, 0]) == 0
    assert np.allclose(K.effective_size(lw), [1 / ((np.e**2 + 1) / (1 + np.e) ** 2), 3, 2])


def test_particle_filter_on_lorenz():
    t, x, y = S.lorenz_series()
    prior = lambda rng, n: np.ones(3) + np.sqrt(5.0) * rng.normal(size=(n, 3))
    mean, cov, smooth, size = K.particle_filter(catalog.Lorenz63(), prior, 7, t, y, 2000, lag=20, seed=42)
    filt, smoothed = rms(mean - x), rms(smooth[20:] - x[:-20])
    assert filt < 1.10 and smoothed < 0.85 and smoothed < filt
    again = K.particle_filter(catalog.Lorenz63(), prior, 7, t, y, 2000, lag=20, seed=42)
    assert np.array_equal(mean, again[0]) and (cov[:, [0, 1, 2], [0, 1, 2]] >= 0).all()


def test_rao_blackwell_on_turns():
    t, x, y = S.turn_series()
    both, smooth, _ = K.rao_blackwell(catalog.TurnRate(), np.zeros(1), [0.0, 0, 10, 0], np.eye(4), 1, t, y, 1000, lag=10, seed=42)
    error = np.sqrt(((both[:, 1:3] - x[:, :2]) ** 2).sum(1)).mean()
    assert 0 < error < 2.5


@pytest.mark.parametrize("cond", [1e2, 1e6])
def test_log_determinant(cond):
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    d = np.array([1, np.sqrt(cond), cond])
    assert np.isclose(np.linalg.slogdet(q @ np.diag(d) @ q.T)[1], np.log(d).sum(), rtol=1e-3)
