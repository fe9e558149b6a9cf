import numpy as np
import pytest
import xxhash

from driftline.llm import hamming, simhash

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, fp string, node long, key string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, most=3):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= most:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in rows}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    comp = brute_components(rows)
    assert got == {d: (f"{f:016x}", comp[d]) for d, f in rows}


def test_odd_rows(spark):
    rows = [(5, None, "", 1, ""), (3, " \t\n", "", 1, ""), (9, "a b", None, None, None), (2, "a b", "", 1, ""), (2, "A B", "", 1, ""), (None, "a b", "", 1, ""), (None, "q r s t", "", 1, "")]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    zero, ab = "0" * 16, f"{brute_fingerprint('a b'):016x}"
    want = [(5, zero, 3), (3, zero, 3), (9, ab, 2), (2, ab, 2), (2, ab, 2), (None, ab, 2), (None, f"{brute_fingerprint('q r s t'):016x}", None)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limits", [[0, 0, 0, 0], [1, 1], [1, 0, 0]])
def test_every_allocation_finds_all_links(spark, limits):
    rng = np.random.default_rng(len(limits) + sum(limits))
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ sum((np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(n)) for n in (1, 2, 3, 4)]]))
    rows = [(k, int(f)) for k, f in enumerate(fps)]
    groups = simhash.bit_groups(fps, len(limits))
    frame = spark.createDataFrame([(k, int(np.uint64(f).view(np.int64))) for k, f in rows], "doc_id long, fp long")
    found = hamming.links(simhash.keyed(frame.selectExpr("fp", "doc_id as node"), groups, limits), 3, block=16).collect()
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fp = dict(rows)
    for r in found:
        assert (fp[r.u] ^ fp[r.v]).bit_count() <= 3
        a, b = find(r.u), find(r.v)
        parent[max(a, b)] = min(a, b)
    assert {k: find(k) for k, _ in rows} == brute_components(rows)


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for rows in (1000, 10**6, 10**9, 10**12):
        groups, limits = simhash.allocate(sample, rows, 3)
        assert sum(t + 1 for t in limits) == 4
        assert sorted(b for g in groups for b in g) == list(range(64))


def test_big_group_keeps_one_component(spark):
    """A run far over the block size, of distinct fingerprints within a few bits of one another."""
    rng = np.random.default_rng(1)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, 2, replace=False)) for _ in range(2000)], np.int64))
    frame = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = simhash.linked_components(frame, block=32).collect()
    assert {r.component for r in got} == {0} and len(got) == len(fps)
