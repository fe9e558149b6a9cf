"""State-space models as Column expressions: transitions and observations on scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the models.
OSCILLATOR = {"omega2": 2.0, "damping": 0.5}
DRAG = {"c": 0.001, "g": 9.81}
LORENZ = {"sigma": 10.0, "rho": 28.0, "beta": 8.0 / 3.0}
COUPLED = {"omega": 2.0, "damping": 0.1, "coupling": 0.5, "nonlinearity": 0.3}
VAN_DER_POL = {"mu": 5.0}
OBSERVER = {"radius": 100.0, "rate": 0.1}
REENTRY = {"earth": 6371000.0}


def rk4(deriv: Callable[[list[Column], Column], list[Column]], x: list[Column], t: Column, dt: float) -> list[Column]:
    """One Runge-Kutta step."""
    k1 = deriv(x, t)
    k2 = deriv([a + dt / 2 * b for a, b in zip(x, k1, strict=True)], t + dt / 2)
    k3 = deriv([a + dt / 2 * b for a, b in zip(x, k2, strict=True)], t + dt / 2)
    k4 = deriv([a + dt * b for a, b in zip(x, k3, strict=True)], t + dt)
    return [a + dt / 6 * (p + 2 * q + 2 * r + s) for a, p, q, r, s in zip(x, k1, k2, k3, k4, strict=True)]


def van_der_pol(x: list[Column], t: Column) -> list[Column]:
    """With square-wave forcing of period 2 s, seen at the sub-steps' times."""
    force = F.when(t % 2 < 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return [x[1], VAN_DER_POL["mu"] * (1 - x[0] * x[0]) * x[1] - x[0] + force]


def lorenz63(x: list[Column], t: Column) -> list[Column]:
    return [LORENZ["sigma"] * (x[1] - x[0]), x[0] * (LORENZ["rho"] - x[2]) - x[1], x[0] * x[1] - LORENZ["beta"] * x[2]]


def oscillator_step(x: list[Column], dt: float) -> list[Column]:
    return [x[0] + dt * x[1], x[1] + dt * (-OSCILLATOR["omega2"] * F.sin(x[0]) - OSCILLATOR["damping"] * x[1])]


def drag_ball_step(x: list[Column], dt: float) -> list[Column]:
    speed = F.sqrt(x[2] * x[2] + x[3] * x[3])
    return [x[0] + dt * x[2], x[1] + dt * x[3], x[2] - dt * DRAG["c"] * speed * x[2], x[3] - dt * (DRAG["g"] + DRAG["c"] * speed * x[3])]


def bearing(x: Column, y: Column, t: Column) -> Column:
    """Angle from an observer on a circle."""
    a = OBSERVER["rate"] * t
    return F.atan2(y - OBSERVER["radius"] * F.sin(a), x - OBSERVER["radius"] * F.cos(a))


def range_azimuth_elevation(x: Column, y: Column, z: Column) -> list[Column]:
    """With a guard at zero range and a clamp of the sine."""
    r = F.sqrt(x * x + y * y + z * z)
    safe = F.greatest(r, F.lit(1e-6))
    return [r, F.atan2(y, x), F.asin(F.least(F.greatest(z / safe, F.lit(-1.0)), F.lit(1.0)))]
