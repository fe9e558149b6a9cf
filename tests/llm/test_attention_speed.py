"""Lookups by class give the plain gradients, in less time."""

import time

import numpy as np

from driftline.llm import language_model as lm


def plain(m, x, y, fine):
    """Log probabilities and gradients, symbol by symbol, without tables by class."""
    p, width, stride = m.p, lm.WIDTH, lm.STRIDE
    cur, ids = np.maximum(x[:, stride:], 0), np.maximum(x, 0)
    q, k, v = (p["e"] @ p["q"])[cur], (p["e"] @ p["k"])[ids], (p["e"] @ p["v"])[ids]
    s = q @ k.transpose(0, 2, 1) * np.float32(width**-0.5) + p["rel"][m.back] + m.future + np.where(x < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    a = np.exp(s - s.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    both = np.concatenate([p["e"][cur], a @ v], 2).reshape(-1, 2 * width)
    z = np.maximum(both @ p["w1"] + p["b1"], 0)
    logits = z @ p["w2"] + m.pairs[fine.ravel()]
    prob = np.exp(logits - logits.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    on, at = (y.ravel() >= 0).astype(np.float32), (np.arange(y.size), np.maximum(y.ravel(), 0))
    logs = np.where(on > 0, np.log(np.maximum(prob[at], 1e-38)), 0).reshape(y.shape)
    prob[at] -= 1
    d = prob * (on / max(1.0, float(on.sum())))[:, None]
    g = {"w2": z.T @ d}
    dz = (d @ p["w2"].T) * (z > 0)
    g["w1"], g["b1"] = both.T @ dz, dz.sum(0)
    dboth = (dz @ p["w1"].T).reshape(len(x), stride, 2 * width)
    dc = dboth[:, :, width:]
    da = dc @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(2, keepdims=True))
    g["rel"] = np.bincount(m.back.ravel(), ds.sum(0).ravel(), minlength=2 * stride).astype(np.float32)
    ds = ds * np.float32(width**-0.5)
    de = np.zeros_like(p["e"])
    np.add.at(de, cur.ravel(), dboth[:, :, :width].reshape(-1, width))
    for name, grad, index in (("q", ds @ k, cur), ("k", ds.transpose(0, 2, 1) @ q, ids), ("v", a.transpose(0, 2, 1) @ dc, ids)):
        table = np.zeros_like(p["e"])
        np.add.at(table, index.ravel(), grad.reshape(-1, width))
        g[name] = p["e"].T @ table
        de += table @ p[name].T
    return logs, g | {"e": de}


def some(scale):
    rng = np.random.default_rng(2)
    m = lm.Attention(rng.integers(0, 30, (lm.FINE_IN, lm.CLASSES)).astype(float))
    m.load(m.vector() + rng.normal(size=len(m.vector())) * scale)
    seqs = [rng.integers(0, lm.CLASSES, n) for n in (*[50] * 30, 1, 3, 16, 17)]
    return m, lm.Attention.blocks(seqs, [rng.integers(0, lm.FINE, len(s)) for s in seqs])[:3]


def test_same_as_plain():
    for scale in (0.1, 1.0):  # with the larger, exp would overflow and lose rows without a shift
        m, (x, y, fine) = some(scale)
        logs, want = plain(m, x, y, fine)
        ok = (y >= 0) & (logs > -80)
        assert ok.sum() > 200 and np.allclose(m.log_probs(x, y, fine)[ok], logs[ok], rtol=1e-4, atol=1e-3)
        got = m.gradients(x, y, fine)
        for n in m.NAMES:
            assert np.allclose(got[n], want[n], rtol=1e-3, atol=1e-4 * max(1.0, np.abs(want[n]).max())), (n, scale)


def test_faster_than_plain():
    m, (x, y, fine) = some(0.1)

    def least(f):
        times = []
        for _ in range(15):
            began = time.perf_counter()
            f(x, y, fine)
            times.append(time.perf_counter() - began)
        return min(times)

    assert least(m.gradients) < 0.75 * least(lambda *a: plain(m, *a))
