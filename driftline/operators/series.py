"""Filters and smoothers of any size over keyed series: one shuffle, then batched numpy.

Rows are dealt by series and sorted by time; a task takes many series at once, pads them to one
length, and runs every step for all of them together, so that Python's cost is for each step of a
batch and not for each row. A series that record batches split is held until it is whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import kernels

#: Series, padded rows and padded covariance entries of a batch, at most (a longer series is a batch of its own).
SERIES, ROWS, ENTRIES = 256, 200_000, 2_000_000
OUT = "series_id long, k int, t double, x array<double>, p array<double>, nis double, x_smooth array<double>, p_smooth array<double>, status int, gated boolean"


@dataclass
class Series:
    """Rows of one series as arrays over its steps; prior and model where they are given by series."""

    id: int
    t: np.ndarray
    y: np.ndarray
    u: np.ndarray | None = None
    x0: np.ndarray | None = None
    p0: np.ndarray | None = None
    model: str | None = None


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; null rows and components are NaN."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    if ((size >= 0) & (size != width)).any():
        raise ValueError(f"arrays of {width} numbers expected, got {sorted(set(size[size >= 0].tolist()))}")
    out = np.full((len(column), width), np.nan)
    out[size >= 0] = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
    return out


def whole_series(batches: Iterator[pa.RecordBatch], ny: int, rows: int = ROWS, nu: int = 0) -> Iterator[list[Series]]:
    """Lists of whole series, whose number times the longest one's steps is at most ``rows`` (or one series)."""
    held: list[list[Series]] = []  # the parts of each series
    longest = 0
    for b in batches:
        if not b.num_rows:
            continue
        names = set(b.schema.names)
        ids, t, y = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), ny)
        u = _matrix(b.column("u"), nu) if "u" in names else None
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if not held or held[-1][0].id != ids[i]:
                if held:
                    size = sum(len(part.t) for part in held[-1])
                    if len(held) > 1 and max(longest, size) * len(held) > rows:
                        yield [_joined(parts) for parts in held[:-1]]
                        held, longest = held[-1:], 0
                    longest = max(longest, size)
                    if len(held) >= SERIES or longest * (len(held) + 1) > rows:
                        yield [_joined(parts) for parts in held]
                        held, longest = [], 0
                own = {c: b.column(c)[i].as_py() for c in ("x0", "p0", "model") if c in names}
                held.append([])
            else:
                own = {}
            held[-1].append(Series(int(ids[i]), t[i:j], y[i:j], None if u is None else u[i:j], **own))
    if held:
        size = sum(len(part.t) for part in held[-1])
        if len(held) > 1 and max(longest, size) * len(held) > rows:
            yield [_joined(parts) for parts in held[:-1]]
            held = held[-1:]
        yield [_joined(parts) for parts in held]


def _joined(parts: list[Series]) -> Series:
    first = parts[0]
    return Series(first.id, np.concatenate([s.t for s in parts]), np.concatenate([s.y for s in parts]), None if first.u is None else np.concatenate([s.u for s in parts]), first.x0, first.p0, first.model)


def padded(series: list[Series], ny: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, t, y and which steps are real."""
    longest = max(len(s.t) for s in series)
    t, y = np.zeros((len(series), longest)), np.full((len(series), longest, ny), np.nan)
    live = np.zeros((len(series), longest), bool)
    for i, s in enumerate(series):
        n = len(s.t)
        t[i, :n], t[i, n:], y[i, :n], live[i, :n] = s.t, s.t[-1], s.y, True
    return np.array([s.id for s in series]), t, y, live


def _controls(series: list[Series], longest: int, nu: int) -> np.ndarray | None:
    if not nu:
        return None
    u = np.zeros((len(series), longest, nu))
    for i, s in enumerate(series):
        u[i, : len(s.u)] = np.nan_to_num(s.u)
    return u


def _lists(a: np.ndarray, has: np.ndarray | None = None) -> pa.Array:
    """Rows of an array as lists; those that ``has`` leaves out are null."""
    flat = a.reshape(len(a), -1)
    at = pa.array(np.arange(len(a) + 1, dtype=np.int32) * flat.shape[1])
    return pa.ListArray.from_arrays(at, pa.array(flat.ravel()), mask=None if has is None else pa.array(~has))


def filtered(
    measurements: DataFrame,
    make: Callable[[], kernels.Ekf] | Mapping[str, Callable[[], kernels.Ekf]],
    x0,
    p0,
    smoother: str | None = None,
    lag: int = 0,
    rounds: int = 0,
    first: str = "update",
    by_series: DataFrame | None = None,
    nu: int = 0,
) -> DataFrame:
    """One row for each measurement: estimate, covariance (row by row), NIS and status, and the smoothed estimate of the same step.

    ``measurements`` has series_id, t, y (array); rows are put in time order here. ``smoother`` is
    None, "fixed_lag" (the last ``lag`` rows of a series have no smoothed value: null) or "full"
    (``rounds`` more passes for the iterated smoother). Rows with a null series or time take no part; a
    null y only predicts; at equal times the order is that of y. ``gated`` says that the NIS is beyond the filter's gate.

    ``by_series`` has series_id, x0, p0 (row by row) and model: a series' own prior and, where ``make`` maps names to
    filters, its own filter. A series without a row or with a null there takes ``x0``, ``p0`` and the first filter; of several rows the least counts. With
    ``nu`` the measurements have a control u of that many numbers, which drives the prediction that leads to its row (null: zeros).
    """
    x0, p0 = np.asarray(x0, float), np.asarray(p0, float)
    makers = dict(make) if isinstance(make, Mapping) else {None: make}
    default, n = next(iter(makers)), x0.shape[-1]

    def run(batches):
        ny = makers[default]().m.ny
        for series in whole_series(batches, ny, max(1, min(ROWS, ENTRIES // (n * n))), nu):
            groups = {}
            for s in series:
                groups.setdefault(default if s.model is None else s.model, []).append(s)
            for name, same in groups.items():
                yield part(makers[name], same, ny)

    def part(maker, series, ny):
        f = maker()
        ids, t, y, live = padded(series, ny)
        u = _controls(series, t.shape[1], nu)
        x, p = x0, p0
        if any(s.x0 is not None or s.p0 is not None for s in series):
            x = np.stack([x0 if s.x0 is None else np.asarray(s.x0, float) for s in series])
            p = np.stack([p0 if s.p0 is None else np.asarray(s.p0, float).reshape(n, n) for s in series])
        xs = ps = None
        if smoother == "full":
            r, xs, ps = kernels.iterated(maker, x, p, t, y, rounds, first, live, u)
        else:
            r = kernels.run(f, x, p, t, y, first, live, u)
            if smoother == "fixed_lag":
                xs, ps = kernels.fixed_lag(r, lag)
        return emit(ids, t, live, r, xs, ps, getattr(f, "gate", np.inf))

    def emit(ids, t, live, r, xs, ps, gate):
        i, k = np.nonzero(live)
        size = np.asarray(live.sum(1))
        names = [c.split()[0] for c in OUT.split(", ")]
        nis = r["nis"][k, i]
        columns = [pa.array(ids[i]), pa.array(k.astype(np.int32)), pa.array(t[i, k]), _lists(r["x"][k, i]), _lists(r["p"][k, i]), pa.array(nis, from_pandas=True)]
        if xs is None or not len(xs):
            columns += [pa.nulls(len(i), pa.list_(pa.float64()))] * 2
        else:
            has = k < size[i] - (lag if smoother == "fixed_lag" else 0)
            at = np.where(has, k, 0)
            columns += [_lists(a[at, i], has) for a in (xs, ps)]
        columns += [pa.array(r["status"][k, i].astype(np.int32)), pa.array(np.nan_to_num(nis) > gate)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = measurements.select(F.col("series_id").cast("long"), F.col("t").cast("double"), F.col("y").cast("array<double>"), *[F.col("u").cast("array<double>")] * bool(nu)).where("series_id is not null and t is not null")
    if by_series is not None:
        own = by_series.select(F.col("series_id").cast("long"), *[F.col(c).cast("array<double>") if c in by_series.columns else F.lit(None).cast("array<double>").alias(c) for c in ("x0", "p0")], (F.col("model").cast("string") if "model" in by_series.columns else F.lit(None).cast("string")).alias("model"))
        least = own.groupBy("series_id").agg(F.min(F.struct("x0", "p0", "model")).alias("own"))
        rows = rows.join(least, "series_id", "left").select(*rows.columns, "own.x0", "own.p0", "own.model")
    return rows.repartition("series_id").sortWithinPartitions("series_id", "t", "y").mapInArrow(run, OUT)


PARTICLE_OUT = "series_id long, k int, t double, x array<double>, x_smooth array<double>, ess double"


def particle_filtered(measurements: DataFrame, run_one: Callable, ny: int, lag: int = 0, together: bool = False) -> DataFrame:
    """Particle filters, one series at a time: ``run_one(series_id, t, y)`` gives means, lagged means and ess by step.

    With ``together`` it takes lists of many series' ids, times and readings, and gives a list. ``x_smooth`` of a row is the
    estimate of the step ``lag`` rows before it, null in the first rows.
    """

    def run(batches):
        for series in whole_series(batches, ny):
            columns = [[s.id for s in series], [s.t for s in series], [s.y for s in series]]
            found = run_one(*columns) if together else map(run_one, *columns)
            mean, smooth, size = (np.concatenate(v) for v in zip(*[(m, x, np.broadcast_to(e, len(m))) for m, x, e in found], strict=True))
            n = [len(s.t) for s in series]
            k = np.concatenate([np.arange(c) for c in n])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(columns[0], n)), pa.array(k.astype(np.int32)), pa.array(np.concatenate(columns[1])), _lists(mean), _lists(smooth, k >= lag), pa.array(size)], names=["series_id", "k", "t", "x", "x_smooth", "ess"])

    rows = measurements.select(F.col("series_id").cast("long"), F.col("t").cast("double"), F.col("y").cast("array<double>")).where("series_id is not null and t is not null")
    return rows.repartition("series_id").sortWithinPartitions("series_id", "t", "y").mapInArrow(run, PARTICLE_OUT)
