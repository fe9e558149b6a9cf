"""Filter and smoother steps in numpy, batched over series: x (b, n), covariances (b, n, n)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from driftline.functions.catalog import wrap


def sym(p):
    return 0.5 * (p + np.swapaxes(p, -1, -2))


def outer(w, a, b):
    """Sum of w_i a_i b_i' over the points' axis (-2)."""
    return np.einsum("i,...ij,...ik->...jk", w, a, b)


def quadratic(p, e):
    """e' P^-1 e."""
    return np.einsum("...i,...i->...", e, np.linalg.solve(p, e[..., None])[..., 0])


def factor(p, jitter=(0.0, 1e-6)):
    """Lower factor of each matrix: Cholesky, then with jitter, then from clipped eigenvalues. One bad matrix costs the others nothing."""
    try:
        return np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        pass
    n = p.shape[-1]
    flat, out = p.reshape(-1, n, n), []
    for m in flat:
        for j in jitter:
            try:
                out.append(np.linalg.cholesky(m + j * np.eye(n)))
                break
            except np.linalg.LinAlgError:
                continue
        else:
            if np.isfinite(m).all():
                w, v = np.linalg.eigh(sym(m))
                out.append(np.linalg.qr((v * np.sqrt(np.maximum(w, 1e-10))).T, mode="r").T)
            else:
                out.append(np.full((n, n), np.nan))
    return np.array(out).reshape(p.shape)


def gain(pht, s):
    """P H' S^-1, by solving; pseudo-inverse where S is singular. One singular matrix costs the others nothing."""
    try:
        return np.swapaxes(np.linalg.solve(s, np.swapaxes(pht, -1, -2)), -1, -2)
    except np.linalg.LinAlgError:
        if s.ndim > 2:
            s = np.broadcast_to(s, (*pht.shape[:-2], *s.shape[-2:]))
            return np.stack([gain(a, b) for a, b in zip(pht, s, strict=True)])
        return pht @ np.linalg.pinv(s)


def wrapped(d, which):
    if which:
        d = d.copy()
        d[..., list(which)] = wrap(d[..., list(which)])
    return d


@dataclass(frozen=True)
class Scaling:
    """Merwe's sigma-point scaling with the guard against a vanishing spread."""

    alpha: float = 1e-3
    beta: float = 2.0
    kappa: float = 0.0

    def weights(self, n):
        kappa = self.kappa
        lam = self.alpha**2 * (n + kappa) - n
        if n + lam < 0.5:
            kappa = n / self.alpha**2 - n
            lam = self.alpha**2 * (n + kappa) - n
        wm = np.full(2 * n + 1, 1 / (2 * (n + lam)))
        wc = wm.copy()
        wm[0] = lam / (n + lam)
        wc[0] = wm[0] + 1 - self.alpha**2 + self.beta
        return n + lam, wm, wc


def square_root_scaling(n: int) -> Scaling:
    """The square-root filter's own choice."""
    return Scaling(1.0, 2.0, 3.0 - n if n <= 5 else 0.0)


def sigma_points(x, factor_, spread):
    d = np.sqrt(spread) * np.swapaxes(factor_, -1, -2)
    c = x[..., None, :]
    return np.concatenate([c, c + d, c - d], -2)


class Ekf:
    """Extended Kalman filter; Joseph update."""

    def __init__(self, model, wrap_angles=False):
        self.m, self.angles = model, model.angular_obs if wrap_angles else ()

    def start(self, x, p):
        return {"x": x, "p": p}

    def cov(self, s):
        return s["p"]

    def predict(self, s, t, u=None):
        f = self.m.fx(s["x"], t, u)
        c = s["p"] @ np.swapaxes(f, -1, -2)
        return {"x": self.m.f(s["x"], t, u), "p": sym(f @ s["p"] @ np.swapaxes(f, -1, -2) + self.m.q(t))}, c

    def update(self, s, y, t):
        h = self.m.hx(s["x"], t)
        e = wrapped(y - self.m.h(s["x"], t), self.angles)
        pht = s["p"] @ np.swapaxes(h, -1, -2)
        v = h @ pht + self.m.r(t)
        k = gain(pht, v)
        i = np.eye(self.m.nx) - k @ h
        p = sym(i @ s["p"] @ np.swapaxes(i, -1, -2) + k @ self.m.r(t) @ np.swapaxes(k, -1, -2))
        return {"x": s["x"] + (k @ e[..., None])[..., 0], "p": p}, quadratic(v, e)


class Ukf(Ekf):
    """Unscented Kalman filter; points are drawn again for the update."""

    def __init__(self, model, scaling=None, wrap_angles=False):
        super().__init__(model, wrap_angles)
        self.spread, self.wm, self.wc = (scaling or Scaling()).weights(model.nx)

    def predict(self, s, t, u=None):
        pts = sigma_points(s["x"], factor(s["p"]), self.spread)
        new = self.m.f(pts, t if np.ndim(t) == 0 else np.asarray(t)[..., None], None if u is None else u[..., None, :])
        x = self.wm @ new
        d = new - x[..., None, :]
        return {"x": x, "p": sym(outer(self.wc, d, d) + self.m.q(t))}, outer(self.wc, pts - s["x"][..., None, :], d)

    def update(self, s, y, t):
        pts = sigma_points(s["x"], factor(s["p"]), self.spread)
        z = self.m.h(pts, t if np.ndim(t) == 0 else np.asarray(t)[..., None])
        mean = self.wm @ z
        dz, dx = z - mean[..., None, :], pts - s["x"][..., None, :]
        v, pxy = sym(outer(self.wc, dz, dz) + self.m.r(t)), outer(self.wc, dx, dz)
        k = gain(pxy, v)
        e = wrapped(y - mean, self.angles)
        kt = np.swapaxes(k, -1, -2)
        p = sym(s["p"] - k @ np.swapaxes(pxy, -1, -2) - pxy @ kt + k @ v @ kt)
        l = factor(p)
        return {"x": s["x"] + (k @ e[..., None])[..., 0], "p": sym(l @ np.swapaxes(l, -1, -2))}, quadratic(v, e)


def rank_one(s, v, sign):
    """Factor of S S' + sign v v', and which downdates were possible; S is not changed."""
    s, v = s.copy(), v.copy()
    ok = np.ones(s.shape[:-2], bool)
    for k in range(s.shape[-1]):
        d = s[..., k, k]
        r2 = d**2 + sign * v[..., k] ** 2
        ok &= r2 > 0
        r = np.sqrt(np.where(r2 > 0, r2, 1e-20))
        d = np.where(np.abs(d) < 1e-10, 1e-10, d)
        c, q = r / d, v[..., k] / d
        s[..., k, k] = r
        s[..., k + 1 :, k] = (s[..., k + 1 :, k] + sign * q[..., None] * v[..., k + 1 :]) / c[..., None]
        v[..., k + 1 :] = c[..., None] * v[..., k + 1 :] - q[..., None] * s[..., k + 1 :, k]
    return s, ok


class SquareRootUkf(Ekf):
    """Square-root unscented filter: circular means of angular states, wrapped residuals, innovation gate."""

    def __init__(self, model, scaling=None, gate=25.0, reject=False):
        super().__init__(model, True)
        self.spread, self.wm, self.wc = (scaling or square_root_scaling(model.nx)).weights(model.nx)
        self.gate, self.reject = gate, reject

    def start(self, x, p):
        if not np.isfinite(p).all():
            raise ValueError("initial covariance is not finite")
        if np.abs(p - np.swapaxes(p, -1, -2)).max() > 1e-4 * max(1.0, np.abs(p).max()):
            raise ValueError("initial covariance is not symmetric")
        if (np.linalg.eigvalsh(sym(p))[..., 0] < -1e-6 * np.abs(p).max()).any():
            raise ValueError(f"initial covariance cannot be factored; condition number {np.max(np.linalg.cond(p)):.3g}")
        return {"x": x, "s": factor(sym(p))}

    def cov(self, s):
        return s["s"] @ np.swapaxes(s["s"], -1, -2)

    def predict(self, s, t, u=None):
        q = np.broadcast_to(self.m.q(t), s["s"].shape)
        try:
            sq = np.linalg.cholesky(q)
        except np.linalg.LinAlgError:
            q = q + 1e-6 * np.eye(self.m.nx)
            sq = factor(q)
        pts = sigma_points(s["x"], s["s"], self.spread)
        new = self.m.f(pts, t if np.ndim(t) == 0 else np.asarray(t)[..., None], None if u is None else u[..., None, :])
        x = self.wm @ new
        for i in self.m.angular_states:
            x[..., i] = np.arctan2(np.sin(new[..., i]) @ self.wm, np.cos(new[..., i]) @ self.wm)
        d = wrapped(new - x[..., None, :], self.m.angular_states)
        rows = np.concatenate([np.sqrt(np.abs(self.wc[1:]))[:, None] * d[..., 1:, :], np.swapaxes(sq, -1, -2)], -2)
        r = np.swapaxes(np.linalg.qr(rows, mode="r"), -1, -2)
        r = r * np.where(np.diagonal(r, axis1=-2, axis2=-1) < 0, -1.0, 1.0)[..., None, :]
        new_s, ok = rank_one(r, np.sqrt(np.abs(self.wc[0])) * d[..., 0, :], 1.0 if self.wc[0] >= 0 else -1.0)
        if not ok.all():
            full = factor(sym(outer(self.wc, d, d) + q + 1e-8 * np.eye(self.m.nx)))
            new_s = np.where(ok[..., None, None], new_s, full)
        return {"x": x, "s": new_s}, outer(self.wc, wrapped(pts - s["x"][..., None, :], self.m.angular_states), d)

    def update(self, s, y, t):
        pts = sigma_points(s["x"], s["s"], self.spread)
        z = self.m.h(pts, t if np.ndim(t) == 0 else np.asarray(t)[..., None])
        mean = self.wm @ z
        dz = z - mean[..., None, :]
        v = sym(outer(self.wc, dz, dz) + self.m.r(t))
        sv = factor(v)
        pxy = outer(self.wc, wrapped(pts - s["x"][..., None, :], self.m.angular_states), wrapped(dz, self.m.angular_obs))
        k = gain(pxy, v)
        e = wrapped(y - mean, self.m.angular_obs)
        nis = quadratic(v, e)
        over = nis > self.gate
        scale = np.where(over, 0.0 if self.reject else np.sqrt(self.gate / np.maximum(nis, self.gate)), 1.0)
        down = np.sqrt(np.maximum(2 * scale - scale**2, 0))[..., None, None] * (k @ sv)
        new_s, fine = s["s"], np.ones(nis.shape, bool)
        for j in range(self.m.ny):
            new_s, ok = rank_one(new_s, down[..., j], -1.0)
            fine &= ok
        if not fine.all():
            full = factor(sym(self.cov(s) - down @ np.swapaxes(down, -1, -2)) + 1e-8 * np.eye(self.m.nx))
            new_s = np.where(fine[..., None, None], new_s, full)
        return {"x": s["x"] + scale[..., None] * (k @ e[..., None])[..., 0], "s": new_s}, nis


FILTERS = {"ekf": Ekf, "ukf": Ukf, "srukf": SquareRootUkf}


def run(filter_, x0, p0, t, y, first: str = "update", live=None, u=None):
    """Filters all steps of a batch: t (b, k), y (b, k, ny), NaN rows in y predict only, ``live`` (b, k) marks real steps,
    the control u (b, k, nu) of a step drives the prediction that leads to it.

    Returns arrays over (k, b): x, p, x_pred, p_pred, cross, nis, status (0 fine, 1 not finite: the prior
    state stays, so that one bad step does not spoil the series).
    """
    b, steps = t.shape
    live = np.ones((b, steps), bool) if live is None else live
    state = filter_.start(np.broadcast_to(x0, (b, len(np.atleast_1d(x0)[..., :]) if np.ndim(x0) == 1 else x0.shape[-1])).astype(float).copy(), np.broadcast_to(p0, (b, *np.shape(p0)[-2:])).astype(float).copy())
    n = state["x"].shape[-1]
    out = {"x": np.empty((steps, b, n)), "p": np.empty((steps, b, n, n)), "x_pred": np.empty((steps, b, n)), "p_pred": np.empty((steps, b, n, n)), "cross": np.zeros((steps, b, n, n)), "nis": np.full((steps, b), np.nan), "status": np.zeros((steps, b), int)}

    def pick(mask, a, c):
        return {k: np.where(mask.reshape(-1, *[1] * (a[k].ndim - 1)), a[k], c[k]) for k in a}

    for k in range(steps):
        before, new, cross = state, state, np.zeros((b, n, n))
        if k or first == "predict":
            new, cross = filter_.predict(state, t[:, max(k - 1, 0)], None if u is None else u[:, k])
        pred = new
        seen = ~np.isnan(y[:, k]).any(-1)
        if seen.any() and not (k == 0 and first == "skip"):
            after, nis = filter_.update(new, np.where(np.isnan(y[:, k]), 0.0, y[:, k]), t[:, k])
            new = pick(seen, after, new)
            out["nis"][k] = np.where(seen, nis, np.nan)
        p = filter_.cov(new)
        bad = ~(np.isfinite(new["x"]).all(-1) & np.isfinite(p).all((-1, -2)))
        keep = live[:, k] & ~bad
        state = pick(keep, new, before)
        pred = pick(keep, pred, before)
        out["x"][k], out["p"][k], out["cross"][k] = state["x"], filter_.cov(state), cross
        out["x_pred"][k], out["p_pred"][k], out["status"][k] = pred["x"], filter_.cov(pred), bad
    return out


def rts(r, live=None):
    """Smoothed x and p of all stored steps (k, b, ...), from the newest backwards; steps that ``live`` (b, k) leaves out smooth none."""
    xs, ps = r["x"].copy(), r["p"].copy()
    steps = len(xs)
    for k in range(steps - 2, -1, -1):
        g = gain(r["cross"][k + 1], r["p_pred"][k + 1])
        ok = (r["status"][k + 1] == 0) & np.isfinite(g).all((-1, -2))
        if live is not None:
            ok &= live[:, k + 1]
        x = r["x"][k] + (g @ (xs[k + 1] - r["x_pred"][k + 1])[..., None])[..., 0]
        p = sym(r["p"][k] + g @ (ps[k + 1] - r["p_pred"][k + 1]) @ np.swapaxes(g, -1, -2))
        xs[k], ps[k] = np.where(ok[:, None], x, r["x"][k]), np.where(ok[:, None, None], p, r["p"][k])
    return xs, ps


def fixed_lag(r, lag: int):
    """x and p of step k given the steps up to k + lag, for k = 0 .. steps - 1 - lag; all windows at once."""
    steps = len(r["x"])
    if steps <= lag:
        return r["x"][:0], r["p"][:0]
    xs, ps = r["x"][lag:], r["p"][lag:]
    for back in range(1, lag + 1):
        s = slice(lag - back, steps - back)
        n = slice(lag - back + 1, steps - back + 1)
        g = gain(r["cross"][n], r["p_pred"][n])
        xs = r["x"][s] + (g @ (xs - r["x_pred"][n])[..., None])[..., 0]
        ps = sym(r["p"][s] + g @ (ps - r["p_pred"][n]) @ np.swapaxes(g, -1, -2))
    return xs, ps


def iterated(make, x0, p0, t, y, rounds: int, first="update", live=None, u=None):
    """Backward pass, then ``rounds`` times: restart from the smoothed first state with the original covariance."""
    r = run(make(), x0, p0, t, y, first, live, u)
    xs, ps = rts(r, live)
    for _ in range(rounds):
        r = run(make(), xs[0], p0, t, y, first, live, u)
        xs, ps = rts(r, live)
    return r, xs, ps


# --- particles ----------------------------------------------------------------------------------

#: Particles of all series that are filtered together, at most (or one series).
AT_ONCE = 1 << 16


def log_normalize(lw):
    ok = np.isfinite(lw)
    top = np.where(ok, lw, -np.inf).max(-1, keepdims=True)
    dead = ~np.isfinite(top)
    e = np.where(ok, lw - np.where(dead, 0, top), -np.inf)
    out = e - np.log(np.maximum(np.exp(e).sum(-1, keepdims=True), 1e-300))
    return np.where(dead, -np.log(lw.shape[-1]), out)


def effective_size(lw):
    return np.clip(1 / np.exp(2 * lw).sum(-1), 1, lw.shape[-1])


def resample(w, rng, scheme):
    """Parents by systematic or stratified points on the cumulative weights, of each row; ``rng`` may be a list, one for each row."""
    n = w.shape[-1]
    wide = 1 if scheme == "systematic" else n
    u = np.stack([g.random(wide) for g in rng]) if isinstance(rng, list) else rng.random((len(w), wide))
    points = (np.arange(n) + u) / n
    cdf = np.cumsum(w, -1)
    return np.stack([np.minimum(np.searchsorted(c, p, "left"), n - 1) for c, p in zip(cdf, points, strict=True)])


def generator(seed: int, series: int, step: int):
    """Random numbers that depend on the seed, series and step alone, not on partitioning."""
    return np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), series & (2**64 - 1)], counter=[0, 0, 0, step]))


class _Steps:
    """The generators of one series' steps, one object set anew for each, which takes a fraction of making one."""

    def __init__(self, seed: int, series: int):
        self.rng = generator(seed, series, 0)
        self.state = self.rng.bit_generator.state

    def at(self, step: int):
        self.state["state"]["counter"][3] = step
        self.rng.bit_generator.state = self.state
        return self.rng


def particle_filter(model, prior, series: int, t, y, particles=1000, threshold=0.5, scheme="stratified", seed=0, lag=0):
    """Bootstrap filter of one series; filtered mean and covariance, smoothed mean ``lag`` steps back, and ess, by step.

    Estimates are read after resampling. The smoothed mean follows each particle's parents.
    """
    return particle_filters(model, prior, [series], [t], [y], particles, threshold, scheme, seed, lag)[0]


def particle_filters(model, prior, series, t, y, particles=1000, threshold=0.5, scheme="stratified", seed=0, lag=0):
    """particle_filter of many series, each step for all of them that have it; a list of each one's results.

    Random numbers are each series' own. A model with ``batched`` set takes readings (series, 1, ny), times (series, 1) and
    particles (series, particles, n) at once in ``loglik``.
    """
    if (some := max(1, AT_ONCE // particles)) < len(series):
        parts = [slice(k, k + some) for k in range(0, len(series), some)]
        return [r for k in parts for r in particle_filters(model, prior, series[k], t[k], y[k], particles, threshold, scheme, seed, lag)]
    size = np.array([len(x) for x in t])
    order = np.argsort(-size, kind="stable")
    steps = [_Steps(seed, series[i]) for i in order]
    x = np.stack([prior(s.at(0), particles) for s in steps])
    lw = np.full((len(x), particles), -np.log(particles))
    out = [[] for _ in series]
    layers, maps, every = [x], [], np.arange(particles)
    for k in range(int(size.max(initial=0))):
        n = int((size > k).sum())
        x, lw = x[:n], lw[:n]
        layers, maps = [v[:n] for v in layers], [m[:n] for m in maps]
        at = order[:n].tolist()
        rngs = [s.at(k + 1) for s in steps[:n]]
        now, seen = np.array([t[i][k] for i in at]), np.stack([y[i][k] for i in at])
        x = np.stack([model.propagate(a, b, None, rng) for a, b, rng in zip(x, now, rngs, strict=True)])
        has = np.flatnonzero(~np.isnan(seen).any(-1))
        if len(has):
            if getattr(model, "batched", False):
                ll = model.loglik(seen[has, None], x[has], now[has, None])
            else:
                ll = np.stack([model.loglik(seen[i], x[i], now[i]) for i in has])
            lw = lw.copy()
            lw[has] = log_normalize(lw[has] + ll)
        ess = effective_size(lw)
        parent = np.repeat(every[None], n, 0)
        few = np.flatnonzero(ess < threshold * particles)
        if len(few):
            w = np.exp(lw[few])
            parent[few] = resample(w, [rngs[i] for i in few.tolist()], scheme)
            x[few] = np.take_along_axis(x[few], parent[few][..., None], 1)
            lw[few] = -np.log(particles)
        layers, maps = [*layers, x][-(lag + 1) :], [*maps, parent][-lag:] if lag else []
        w = np.exp(lw)
        mean = (w[:, None] @ x)[:, 0]
        d = x - mean[:, None]
        path = np.repeat(every[None], n, 0)
        for m in reversed(maps[-(len(layers) - 1) :] if len(layers) > 1 else []):
            path = np.take_along_axis(m, path, 1)
        cov = np.swapaxes(w[..., None] * d, -1, -2) @ d
        smooth = (w[:, None] @ np.take_along_axis(layers[0], path[..., None], 1))[:, 0]
        for j, i in enumerate(at):
            out[i].append((mean[j], cov[j], smooth[j], ess[j]))
    return [[np.array(v) for v in zip(*rows, strict=True)] for rows in out]


def rao_blackwell(model, z0, x0, p0, series: int, t, y, particles=100, threshold=0.5, scheme="systematic", seed=123456789, lag=0):
    """Particles over the nonlinear part, a Kalman filter in each; filtered and lagged means by step."""
    z = np.broadcast_to(np.asarray(z0, float), (particles, model.n_nl)).copy()
    x = np.broadcast_to(np.asarray(x0, float), (particles, model.n_lin)).copy()
    p = np.broadcast_to(np.asarray(p0, float), (particles, model.n_lin, model.n_lin)).copy()
    lw = np.full(particles, -np.log(particles))
    layers, maps, out = [np.concatenate([z, x], 1)], [], []
    for k in range(len(t)):
        rng = generator(seed, series, k + 1)
        bias, a, q = model.dynamics(z, t[k])
        z = model.propagate(z, t[k], rng)
        x = np.einsum("...ij,...j->...i", a, x) + bias
        p = sym(a @ p @ np.swapaxes(a, -1, -2) + q)
        offset, h, r = model.observation(z, t[k])
        if not np.isnan(y[k]).any():
            e = y[k] - (x @ np.swapaxes(h, -1, -2) + offset)
            s = h @ p @ np.swapaxes(h, -1, -2) + r
            sign, logdet = np.linalg.slogdet(s)
            ll = -0.5 * (quadratic(s, e) + logdet + model.ny * np.log(2 * np.pi))
            g = gain(p @ np.swapaxes(h, -1, -2), s)
            x = x + (g @ e[..., None])[..., 0]
            i = np.eye(model.n_lin) - g @ h
            p = sym(i @ p @ np.swapaxes(i, -1, -2) + g @ r @ np.swapaxes(g, -1, -2))
            lw = log_normalize(lw + np.where(sign > 0, ll, -np.inf))  # a broken particle never wins
        size = 1 / np.exp(2 * lw).sum()
        parent = np.arange(particles)
        if size < threshold * particles:
            parent = resample(np.exp(lw)[None], rng, scheme)[0]
            z, x, p, lw = z[parent], x[parent], p[parent], np.full(particles, -np.log(particles))
        both = np.concatenate([z, x], 1)
        layers, maps = [*layers, both][-(lag + 1) :], [*maps, parent][-lag:] if lag else []
        path = np.arange(particles)
        for m in reversed(maps[-(len(layers) - 1) :] if len(layers) > 1 else []):
            path = m[path]
        w = np.exp(lw)
        out.append((w @ both, w @ layers[0][path], size))
    return [np.array(v) for v in zip(*out, strict=True)]
