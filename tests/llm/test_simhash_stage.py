"""The pipeline's near-duplicate stage goes through SimHash and the pigeonhole, and its bits drop no similar pair."""

import random

import numpy as np
import pytest

import corpus_pipeline
from driftline.llm import simhash
from tests.llm.test_similar_documents import brute


def rows_of(rnd, count):
    rows = []
    for k in range(count):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([6, 30, 120]))]
        near = list(w)
        for _ in range(max(1, len(w) // 60)):
            near[rnd.choice([0, -1, rnd.randrange(len(w))])] = "other"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    return rows


def test_stage_links_by_simhash(spark, monkeypatch):
    seen = []
    linked = simhash.linked_components

    def spy(fps, *args, **kw):
        out = linked(fps, *args, **kw)
        seen.append(({r.fp for r in fps.collect()}, {r.fp: r.component for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "linked_components", spy)
    rows = rows_of(random.Random(0), 60) + [(1000, None), (1001, ""), (1002, "a b c " * 400), (1003, "a b c " * 300)]
    docs = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).collect())
    assert got == sorted(set(brute(rows).values()))
    (prints, of), = seen
    want = set()
    for _, t in rows:
        some = np.unique(simhash.shingle_hashes((t or "").encode(), 5))
        want.add(int(np.uint64(simhash.majority(some) if len(some) else 0).view(np.int64)))
    assert prints == want == set(of)


@pytest.mark.parametrize("n", [20, 60, 400])
def test_bits_keep_similar_sets(n):
    rng = np.random.default_rng(n)
    apart = []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        a, b = both[: n - n // 10], both[n // 10 :]  # eight of ten in both
        apart.append(np.bitwise_count(np.bitwise_xor(*simhash._prints_of([a, b]).view(np.uint64))))
    assert max(apart) <= simhash.MOST_APART and simhash.BITS_FROM == 20
    assert np.mean(np.array(apart) > 3) > 0.9  # why op10's bits alone do not do
