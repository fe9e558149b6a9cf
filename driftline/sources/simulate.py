"""Simulated trajectories as tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.functions import catalog

SCHEMA = "series_id long, k int, t double, x array<double>, y array<double>"


class Normals:
    """Single-precision normal numbers by the polar method from a 32-bit Mersenne Twister, the second of each pair kept."""

    def __init__(self, seed: int):
        self.bits = np.random.MT19937()
        self.bits._legacy_seeding(seed)
        self.kept = None
        self.pool: list[int] = []

    def _uniform(self):
        if not self.pool:
            self.pool = (self.bits.random_raw(4096) & 0xFFFFFFFF)[::-1].tolist()
        u = np.float32(self.pool.pop()) / np.float32(4294967296.0)
        return u if u < 1 else np.nextafter(np.float32(1), np.float32(0))

    def one(self):
        if self.kept is not None:
            v, self.kept = self.kept, None
            return v
        one, two = np.float32(1), np.float32(2)
        while True:
            x, y = two * self._uniform() - one, two * self._uniform() - one
            r = x * x + y * y
            if 0 < r <= 1:
                break
        m = np.sqrt(np.float32(-2) * np.log(r) / r)
        self.kept = x * m
        return y * m

    def __call__(self, n: int):
        return np.array([self.one() for _ in range(n)], np.float32)


@dataclass(frozen=True)
class Problem:
    """A model with its start, prior, length and metric settings."""

    name: str
    model: object
    x0: tuple[float, ...]
    p0: tuple[float, ...]
    end: float
    dt: float
    seed: int
    lag: int
    diverged: float


EARTH = 6371000.0
#: The benchmark's starts, priors, lengths, seeds, lags and divergence thresholds.
PROBLEMS = {
    "CoupledOscillators10D": Problem("CoupledOscillators10D", catalog.CoupledOscillators(), (1, 0, -0.5, 0, 0.8, 0, -0.3, 0, 0.6, 0), (1,) * 10, 50, 0.01, 42, 20, 10),
    "VanDerPol2D": Problem("VanDerPol2D", catalog.VanDerPol(), (1, 0), (1, 1), 20, 0.01, 43, 20, 10),
    "BearingOnly4D": Problem("BearingOnly4D", catalog.Bearing(), (200, 0, 10, 5), (10,) * 4, 30, 0.1, 44, 30, 500),
    "ReentryVehicle6D": Problem("ReentryVehicle6D", catalog.Reentry(), (EARTH + 56000, 40000, 40000, -500, 2000, -300), (1e5,) * 3 + (1e4,) * 3, 30, 0.1, 45, 20, 5000),
}


def noise_factor(m: np.ndarray) -> np.ndarray:
    """Cholesky factor, or the roots of the diagonal where there is none."""
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return np.diag(np.sqrt(np.maximum(np.diag(m), 0)))


def trajectory(p: Problem, seed: int | None = None, dtype=np.float32):
    """t, truth, measurements of one run, in single precision as the clock and the state add up there.

    A step records x, measures it, moves it, and adds process noise; measurement noise is drawn first.
    """
    normal = Normals(p.seed if seed is None else seed)
    lq, lr = noise_factor(p.model.q(0.0)).astype(dtype), noise_factor(p.model.r(0.0)).astype(dtype)
    x, t, dt, out = np.array(p.x0, dtype), np.float32(0), np.float32(p.dt), ([], [], [])
    while t <= np.float32(p.end):
        y = p.model.h(x, t).astype(dtype) + lr @ normal(p.model.ny)
        for column, v in zip(out, (float(t), x, y), strict=True):
            column.append(v)
        x = (p.model.f(x, t).astype(dtype) + lq @ normal(p.model.nx)).astype(dtype)
        t = np.float32(t + dt)
    return tuple(np.array(v, np.float64) for v in out)


def simulated(spark: SparkSession, problem: str, series: int = 1, seed: int | None = None) -> DataFrame:
    """``series`` independent runs (seed + series number), made on the executors."""
    p = PROBLEMS[problem]
    base = p.seed if seed is None else seed

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                t, x, y = trajectory(p, base + s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), s)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(t), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(y), pa.list_(pa.float64()))], names=["series_id", "k", "t", "x", "y"])

    return spark.range(series, numPartitions=max(1, min(series, 64))).mapInArrow(run, SCHEMA)


def line_series(steps: int = 40, seed: int = 12345):
    """Straight-line truth and bent position readings: t, truth, measurements."""
    m = catalog.NearlyLinear()
    k = np.arange(1, steps + 1)
    truth = np.stack([-40.0 + 2.0 * k, np.full(steps, 2.0)], 1)
    return k.astype(float), truth, m.h(truth, 0) + 2.0 * np.random.default_rng(seed).normal(size=(steps, 1))


def oscillator_series(steps: int = 200, seed: int = 42):
    """The truth moves before it is measured."""
    m, rng, x, out = catalog.Oscillator(), np.random.default_rng(seed), np.array([1.0, 0.0]), ([], [], [])
    for k in range(steps):
        x = m.f(x, 0) + 0.01 * rng.normal(size=2)
        for c, v in zip(out, (k * m.dt, x, m.h(x, 0) + 0.1 * rng.normal(size=1)), strict=True):
            c.append(v)
    return tuple(map(np.array, out))


def drag_ball_series(steps: int = 200, seed: int = 42, start=(0.0, 100.0, 10.0, 0.0)):
    """Measured, then moved; noise on velocities."""
    m, rng, x, out = catalog.DragBall(), np.random.default_rng(seed), np.array(start), ([], [], [])
    for k in range(steps):
        for c, v in zip(out, (k * m.dt, x, m.h(x, 0) + 0.5 * rng.normal(size=2)), strict=True):
            c.append(v)
        x = m.f(x, 0)
        x[2:] += 0.1 * np.sqrt(m.dt) * rng.normal(size=2)
    return tuple(map(np.array, out))


def lorenz_series(steps: int = 500, seed: int = 42):
    m, rng, x, out = catalog.Lorenz63(), np.random.default_rng(seed), np.ones(3), ([], [], [])
    for k in range(1, steps + 1):
        x = m.propagate(x, 0, None, rng)
        z = rng.normal(size=3) * 2.0 / np.sqrt(rng.chisquare(3) / 3)
        for c, v in zip(out, (k * m.dt, x, x + z), strict=True):
            c.append(v)
    return tuple(map(np.array, out))


def turn_series(steps: int = 100, rate: float = 0.1, seed: int = 42):
    m, rng, x, out = catalog.TurnRate(), np.random.default_rng(seed), np.array([0.0, 0.0, 10.0, 0.0]), ([], [], [])
    a = m.dynamics(np.array([[rate]]), 0)[1][0]
    for k in range(steps):
        x = a @ x
        for c, v in zip(out, ((k + 1) * m.dt, x, x[:2] + 2.0 * rng.normal(size=2)), strict=True):
            c.append(v)
    return tuple(map(np.array, out))
