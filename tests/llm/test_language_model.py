import math
import zlib
from collections import Counter

import numpy as np

from driftline.llm import language_model as lm

SCHEMA = "doc_id long, text string, held boolean, k int, flush long, key string"


def brute_base(rows, fold=10, held=0):
    docs = [(d, [*(t or "").encode().lower().split(), b" end"]) for d, t in rows]
    fold_of = lambda d: None if d is None else zlib.crc32(str(d).encode()) % fold == held
    c = Counter(w for d, ws in docs if fold_of(d) is False for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((d, fold_of(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for d, ws in docs), key=str)


def test_gradients_and_normalisation():
    rng = np.random.default_rng(0)
    m = lm.Attention(rng.integers(0, 30, (lm.FINE_IN, lm.CLASSES)).astype(float))
    x, y, f, _ = lm.Attention.blocks([rng.integers(0, lm.CLASSES, 45), rng.integers(0, lm.CLASSES, 3)], [rng.integers(0, lm.FINE, 45), rng.integers(0, lm.FINE, 3)])
    for n in m.NAMES:
        m.p[n] = m.p[n].astype(np.float64) + (0.1 if n in ("b1", "rel") else 0)
    g = m.gradients(x, y, f)
    loss = lambda: -m.log_probs(x, y, f).sum() / (y >= 0).sum()
    for n in m.NAMES:
        at = tuple(rng.integers(0, s) for s in m.p[n].shape) if n != "e" else (int(max(x[0])), 1)
        was, eps = m.p[n][at], 1e-4
        m.p[n][at] = was + eps
        up = loss()
        m.p[n][at] = was - eps
        down = loss()
        m.p[n][at] = was
        assert abs((up - down) / (2 * eps) - g[n][at]) < 2e-3 * max(1, abs(g[n][at])) + 1e-4, n
    logits = m.forward(x, f)
    total = np.exp(logits - np.log(np.exp(logits).sum(1, keepdims=True))).sum(1)
    assert np.allclose(total, 1)


def test_blocks_score_each_symbol_once_and_see_no_future():
    rng = np.random.default_rng(1)
    m = lm.Attention(np.ones((lm.FINE_IN, lm.CLASSES)))
    a = rng.integers(0, lm.CLASSES, 70)
    b = a.copy()
    b[60:] = rng.integers(0, lm.CLASSES, 10)
    for seq in (a, b):
        _, y, _, _ = lm.Attention.blocks([seq], [seq])
        assert sorted(y[y >= 0].tolist()) == sorted(seq.tolist())
    pa_, pb = (m.log_probs(*lm.Attention.blocks([s], [s])[:3]).ravel() for s in (a, b))
    assert np.allclose(pa_[:60], pb[:60], atol=1e-6)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.scores(docs, flush=100_000).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == brute_base([(r.doc_id, r.text) for r in docs.collect()])
    out = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "É É x\x85y \x0b z 日本 😀"), (4, "É"), (6, "w " * 20_000), (7, "<|endoftext|> ­")]
    got = lm.scores(spark.createDataFrame([(d, t, True, 1, 2, "") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == brute_base(rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.scores(spark.createDataFrame([], SCHEMA)).collect() == []
