"""Online filtering: the same kernels on a stream, with keyed state.

Rows of a series may come late or out of order within the watermark. They wait in state until the
watermark has passed them and are then folded in time order, so the result does not depend on how
the input is cut into micro-batches. Rows not later than the last folded time are dropped and counted; rows of one
time that wait together are all folded, in the order of y. A null y only predicts, and null components count as NaN, which does the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from driftline.operators import kernels

OUT = "series_id long, k int, t double, x array<double>, p array<double>, nis double, x_smooth array<double>, dropped long, status int, gated long"
#: What a series keeps: estimate, its factor or covariance, last time, number of steps, dropped rows, gated steps.
STATE = "x array<double>, c array<double>, t double, k int, dropped long, gated long"
STEP = "x array<double>, p array<double>, x_pred array<double>, p_pred array<double>, cross array<double>"


class SeriesProcessor(StatefulProcessor):
    """Folds each series; with ``lag`` it also emits the estimate of the step that many rows before (null until there is one)."""

    def __init__(self, make: Callable[[], kernels.Ekf], x0, p0, lag: int = 0, ttl_ms: int | None = None):
        self.make, self.x0, self.p0, self.lag, self.ttl = make, np.asarray(x0, float), np.asarray(p0, float), lag, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.filter = self.make()
        self.state = handle.getValueState("state", STATE, self.ttl)
        self.pending = handle.getListState("pending", "t double, y array<double>, due long")
        self.history = handle.getListState("history", STEP)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        held, late, due = [], 0, -1
        for frame in rows:
            for t, y, ms in zip(frame["t"], frame["y"], frame["due"], strict=True):
                if last is not None and t <= last[2]:
                    late += 1
                else:
                    held.append((float(t), [] if y is None else [float("nan") if v is None else float(v) for v in y], int(ms)))
                    due = max(due, int(ms))
        if late:
            self.state.update((*last[:4], last[4] + late, last[5]))
        if held:
            self.pending.appendList(held)
            self.handle.registerTimer(due + 1)
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        waiting = list(self.pending.get()) if self.pending.exists() else []
        ready = sorted([r for r in waiting if r[2] <= watermark], key=lambda r: (r[0], [np.inf if np.isnan(v) else v for v in r[1]]))
        if not ready:
            return
        rest = [tuple(r) for r in waiting if r[2] > watermark]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        n, f = self.filter.m.nx, self.filter
        name = "s" if isinstance(f, kernels.SquareRootUkf) else "p"
        if self.state.exists():
            x, c, last, k, dropped, gated = self.state.get()
            s = {"x": np.array(x)[None], name: np.array(c).reshape(1, n, n)}
        else:
            s, last, k, dropped, gated = f.start(self.x0[None].copy(), self.p0[None].copy()), None, 0, 0, 0
        past = [[np.array(v) for v in h] for h in self.history.get()] if self.lag and self.history.exists() else []
        out, folded = [], last
        for t, y, _ in ready:
            if folded is not None and t <= folded and k:
                dropped += 1
                continue
            before, cross = s, np.zeros((1, n, n))
            pred = s
            if k:
                pred, cross = f.predict(s, np.array([last]))
            new, nis, status = pred, [np.nan], 0
            if len(y) and not np.isnan(y).any():
                new, nis = f.update(pred, np.array(y)[None], np.array([t]))
                gated += int(nis[0] > getattr(f, "gate", np.inf))
            if not (np.isfinite(new["x"]).all() and np.isfinite(f.cov(new)).all()):
                new, pred, status = before, before, 1
            s, last, k = new, t, k + 1
            smooth = None
            if self.lag:
                past = [*past, [s["x"][0], f.cov(s)[0].ravel(), pred["x"][0], f.cov(pred)[0].ravel(), cross[0].ravel()]][-(self.lag + 1) :]
                if len(past) == self.lag + 1:
                    r = {a: np.stack([h[i].reshape((1, n) if i in (0, 2) else (1, n, n)) for h in past]) for i, a in enumerate(("x", "p", "x_pred", "p_pred", "cross"))}
                    smooth = kernels.fixed_lag(r, self.lag)[0][0, 0].tolist()
            out.append((key[0], k - 1, t, s["x"][0].tolist(), f.cov(s)[0].ravel().tolist(), None if np.isnan(nis[0]) else float(nis[0]), smooth, dropped, status, gated))
        self.state.update((s["x"][0].tolist(), s[name][0].ravel().tolist(), float(last), k, dropped, gated))
        if self.lag:
            self.history.put([tuple(v.tolist() for v in h) for h in past])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def filtered_stream(rows: DataFrame, make: Callable[[], kernels.Ekf], x0, p0, delay: str, lag: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """Streaming counterpart of the batch filter: ``rows`` has series_id, ts (timestamp), t (seconds), y (array).

    Needs the RocksDB state store provider. Rows later than the watermark's ``delay`` are lost to it.
    """
    marked = rows.withWatermark("ts", delay).withColumn("due", F.unix_millis("ts"))
    return marked.groupBy("series_id").transformWithStateInPandas(SeriesProcessor(make, x0, p0, lag, ttl_ms), OUT, "Append", "EventTime")


def windowed(events: DataFrame, delay: str, window: str, slide: str | None = None) -> DataFrame:
    """Mean value and count by user and time window: raw events made into measurements; batch or stream."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", delay).groupBy(F.col("user_id").alias("series_id"), w).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, delay: str, gap: str) -> DataFrame:
    """The same by session."""
    return events.withWatermark("ts", delay).groupBy(F.col("user_id").alias("series_id"), F.session_window("ts", gap)).agg(F.avg("value").alias("y"), F.count(F.lit(1)).alias("n"))
