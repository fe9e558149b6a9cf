"""State-space models in numpy. Every function takes any leading axes: x has shape (..., nx)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


class Model(Protocol):
    """What a filter asks of a model. ``t`` may be a number or an array of the leading axes."""

    nx: int
    ny: int
    angular_states: tuple[int, ...]
    angular_obs: tuple[int, ...]

    def f(self, x, t, u=None): ...
    def h(self, x, t): ...
    def q(self, t): ...
    def r(self, t): ...


class Base:
    """Defaults: no angles, and Jacobians by central differences."""

    angular_states: tuple[int, ...] = ()
    angular_obs: tuple[int, ...] = ()
    dt = 0.01

    def jac(self, g, x, *args):
        x = np.asarray(x, float)
        cols = []
        for i in range(self.nx):
            step = 1e-6 * np.maximum(1.0, np.abs(x[..., i]))
            up, down = x.copy(), x.copy()
            up[..., i] += step
            down[..., i] -= step
            cols.append((g(up, *args) - g(down, *args)) / (2 * step)[..., None])
        return np.stack(cols, -1)

    def fx(self, x, t, u=None):
        return self.jac(self.f, x, t, u)

    def hx(self, x, t):
        return self.jac(self.h, x, t)


def rk4(deriv, x, t, dt):
    k1 = deriv(x, t)
    k2 = deriv(x + dt / 2 * k1, t + dt / 2)
    k3 = deriv(x + dt / 2 * k2, t + dt / 2)
    k4 = deriv(x + dt * k3, t + dt)
    return x + dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)


def wrap(d):
    """Into [-pi, pi], ties to even."""
    return d - 2 * np.pi * np.rint(d / (2 * np.pi))


@dataclass
class Linear(Base):
    """x' = A x + bias + B u, y = H x + offset."""

    a: np.ndarray
    hm: np.ndarray
    qm: np.ndarray
    rm: np.ndarray
    bias: np.ndarray | float = 0.0
    offset: np.ndarray | float = 0.0
    angular_states: tuple[int, ...] = ()
    angular_obs: tuple[int, ...] = ()

    def __post_init__(self):
        self.nx, self.ny = self.a.shape[0], self.hm.shape[0]

    def f(self, x, t, u=None):
        return x @ self.a.T + self.bias + (0 if u is None else u)

    def h(self, x, t):
        return x @ self.hm.T + self.offset

    def fx(self, x, t, u=None):
        return np.broadcast_to(self.a, (*x.shape[:-1], *self.a.shape))

    def hx(self, x, t):
        return np.broadcast_to(self.hm, (*x.shape[:-1], *self.hm.shape))

    def q(self, t):
        return self.qm

    def r(self, t):
        return self.rm


def ball_toss(dt: float = 0.1) -> Linear:
    """Constant velocity under gravity."""
    a = np.eye(4)
    a[0, 2] = a[1, 3] = dt
    return Linear(a, np.eye(2, 4), 0.01 * np.eye(4), 0.1 * np.eye(2), bias=np.array([0, 0, 0, -9.81 * dt]))


@dataclass
class Oscillator(Base):
    """Damped pendulum by Euler steps; optional scalar control of the velocity."""

    dt: float = 0.05
    nx: int = 2
    ny: int = 1

    def f(self, x, t, u=None):
        force = 0.0 if u is None else np.asarray(u)[..., 0]
        return np.stack([x[..., 0] + self.dt * x[..., 1], x[..., 1] + self.dt * (-2.0 * np.sin(x[..., 0]) - 0.5 * x[..., 1] + force)], -1)

    def h(self, x, t):
        return x[..., :1]

    def q(self, t):
        return 0.001 * np.eye(2)

    def r(self, t):
        return 0.1 * np.eye(1)


@dataclass
class DragBall(Base):
    """Ballistic flight with quadratic drag."""

    dt: float = 0.1
    nx: int = 4
    ny: int = 2

    def f(self, x, t, u=None):
        v = np.sqrt(x[..., 2] ** 2 + x[..., 3] ** 2)
        return np.stack([x[..., 0] + self.dt * x[..., 2], x[..., 1] + self.dt * x[..., 3], x[..., 2] - self.dt * 0.001 * v * x[..., 2], x[..., 3] - self.dt * (0.001 * v * x[..., 3] + 9.81)], -1)

    def h(self, x, t):
        return x[..., :2]

    def q(self, t):
        return np.diag([0.01 * 0.01, 0.01 * 0.01, 0.01 * self.dt, 0.01 * self.dt])

    def r(self, t):
        return 0.25 * np.eye(2)


@dataclass
class Lorenz63(Base):
    """Chaotic flow by Runge-Kutta steps, fully observed, with Student-t observation noise (for particle filters)."""

    dt: float = 0.01
    nx: int = 3
    ny: int = 3
    nu: float = 3.0

    def f(self, x, t, u=None):
        return rk4(lambda z, s: np.stack([10.0 * (z[..., 1] - z[..., 0]), z[..., 0] * (28.0 - z[..., 2]) - z[..., 1], z[..., 0] * z[..., 1] - 8.0 / 3.0 * z[..., 2]], -1), x, t, self.dt)

    def h(self, x, t):
        return x

    def q(self, t):
        return self.dt * np.eye(3)

    def r(self, t):
        return 4.0 * np.eye(3)

    def propagate(self, x, t, u, rng):
        return self.f(x, t, u) + rng.normal(size=x.shape) * np.sqrt(self.dt)

    def loglik(self, y, x, t):
        d2 = ((y[..., None, :] - x) ** 2).sum(-1) / 4.0
        return -0.5 * (self.nu + 3) * np.log1p(d2 / self.nu)


@dataclass
class CoupledOscillators(Base):
    """Five oscillators, each drawn to all others."""

    dt: float = 0.01
    nx: int = 10
    ny: int = 5

    def f(self, x, t, u=None):
        def deriv(z, s):
            p, v = z[..., 0::2], z[..., 1::2]
            d = p[..., None, :] - p[..., :, None]
            force = 0.5 * d.sum(-1) + 0.3 * np.sin(d).sum(-1)
            return np.stack([v, -4.0 * np.sin(p) - 0.1 * v + force], -1).reshape(z.shape)

        return rk4(deriv, x, t, self.dt)

    def h(self, x, t):
        p = x[..., 0::2]
        return p + 0.1 * np.sin(p)

    def q(self, t):
        return np.diag([0.001, 0.01] * 5)

    def r(self, t):
        return 0.1 * np.eye(5)


@dataclass
class Lorenz96(Base):
    """Forty cyclic variables, every fourth observed."""

    dt: float = 0.01
    nx: int = 40
    ny: int = 10

    def f(self, x, t, u=None):
        return rk4(lambda z, s: (np.roll(z, -1, -1) - np.roll(z, 2, -1)) * np.roll(z, 1, -1) - z + 8.0, x, t, self.dt)

    def h(self, x, t):
        return x[..., ::4]

    def q(self, t):
        return 0.1 * np.eye(40)

    def r(self, t):
        return 0.5 * np.eye(10)


@dataclass
class VanDerPol(Base):
    """Stiff oscillator with square-wave forcing and a quadratic observation."""

    dt: float = 0.01
    nx: int = 2
    ny: int = 1

    def f(self, x, t, u=None):
        def deriv(z, s):
            force = np.where(np.fmod(s, 2.0) < 1.0, 1.0, -1.0)
            return np.stack([z[..., 1], 5.0 * (1 - z[..., 0] ** 2) * z[..., 1] - z[..., 0] + force], -1)

        return rk4(deriv, x, t, self.dt)

    def h(self, x, t):
        return x[..., :1] + 0.2 * x[..., :1] ** 2

    def q(self, t):
        return np.diag([0.001, 0.01])

    def r(self, t):
        return 0.2 * np.eye(1)


@dataclass
class Bearing(Base):
    """Constant velocity seen as an angle from an observer on a circle; singular process noise."""

    dt: float = 0.1
    nx: int = 4
    ny: int = 1
    angular_obs: tuple[int, ...] = ()

    def f(self, x, t, u=None):
        return np.concatenate([x[..., :2] + self.dt * x[..., 2:], x[..., 2:]], -1)

    def h(self, x, t):
        a = 0.1 * np.asarray(t)
        return np.arctan2(x[..., 1] - 100.0 * np.sin(a), x[..., 0] - 100.0 * np.cos(a))[..., None]

    def q(self, t):
        return np.diag([0, 0, 0.1, 0.1])

    def r(self, t):
        return 0.01 * np.eye(1)


@dataclass
class Reentry(Base):
    """Vehicle in an exponential atmosphere under central gravity; range, azimuth, elevation from a station."""

    dt: float = 0.1
    nx: int = 6
    ny: int = 3
    earth: float = 6371000.0

    def f(self, x, t, u=None):
        def deriv(z, s):
            p, v = z[..., :3], z[..., 3:]
            r = np.linalg.norm(p, axis=-1, keepdims=True)
            speed = np.linalg.norm(v, axis=-1, keepdims=True)
            rho = 1.225 * np.exp(-(r - self.earth) / 9000.0)
            return np.concatenate([v, -0.5 * rho * speed / 500.0 * v - 3.986004418e14 / np.maximum(r, 1e-6) ** 3 * p], -1)

        return rk4(deriv, x, t, self.dt)

    def h(self, x, t):
        d = x[..., :3] - np.array([self.earth, 0.0, 0.0], x.dtype)
        r = np.linalg.norm(d, axis=-1)
        far = r >= 1e-6
        sine = np.clip(d[..., 2] / np.where(far, r, 1.0), -1, 1)
        return np.stack([r, np.where(far, np.arctan2(d[..., 1], d[..., 0]), 0.0), np.where(far, np.arcsin(sine), 0.0)], -1)

    def q(self, t):
        return np.diag([100.0] * 3 + [1000.0] * 3)

    def r(self, t):
        return np.diag([1e4, 1e-4, 1e-4])


@dataclass
class NearlyLinear(Base):
    """Constant velocity with unit steps and a slightly bent position reading."""

    dt: float = 1.0
    nx: int = 2
    ny: int = 1

    def f(self, x, t, u=None):
        return np.stack([x[..., 0] + self.dt * x[..., 1], x[..., 1]], -1)

    def h(self, x, t):
        return (x[..., 0] * (1 + 0.004 * x[..., 0]))[..., None]

    def q(self, t):
        return np.diag([1e-3, 1e-4])

    def r(self, t):
        return 4.0 * np.eye(1)


@dataclass
class TurnRate:
    """Conditionally linear: turn rate w walks (nonlinear part); position and velocity turn by it (linear part)."""

    dt: float = 0.1
    std_turn: float = 0.05
    std_accel: float = 0.5
    std_range: float = 2.0
    n_nl: int = 1
    n_lin: int = 4
    ny: int = 2
    bias: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def propagate(self, z, t, rng):
        return z + self.std_turn * np.sqrt(self.dt) * rng.normal(size=z.shape)

    def dynamics(self, z, t):
        """bias, A, Q for each particle."""
        w = z[..., 0]
        small = np.abs(w) < 1e-5
        v = np.where(small, 1.0, w)
        s, c = np.sin(w * self.dt), np.cos(w * self.dt)
        a = np.zeros((*w.shape, 4, 4))
        a[..., 0, 0] = a[..., 1, 1] = 1
        a[..., 0, 2] = a[..., 1, 3] = np.where(small, self.dt, s / v)
        a[..., 0, 3] = np.where(small, 0, -(1 - c) / v)
        a[..., 1, 2] = np.where(small, 0, (1 - c) / v)
        a[..., 2, 2] = a[..., 3, 3] = np.where(small, 1, c)
        a[..., 2, 3], a[..., 3, 2] = np.where(small, 0, -s), np.where(small, 0, s)
        q = np.zeros((4, 4))
        q[2, 2] = q[3, 3] = self.std_accel**2 * self.dt
        return self.bias, a, q

    def observation(self, z, t):
        """offset, H, R for each particle."""
        return np.zeros(2), np.eye(2, 4), self.std_range**2 * np.eye(2)
