import numpy as np

from driftline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, copy string, key string, list string"


def brute(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    if not rows:
        return {}
    e = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    norm = np.sqrt((e * e).sum(1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (e * e[q]).sum(1) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    assert set(found) <= set(want)
    hits = sum(len(set(found.get(q, {})) & {i for i, _ in w}) for q, w in want.items())
    for q, w in want.items():
        assert sorted(r for r, _ in found[q].values()) == list(range(1, len(w) + 1))
        scores = [s for _, s in sorted(found[q].values())]
        assert scores == sorted(scores, reverse=True)
        for i, s in w:
            if i in found[q]:
                assert abs(found[q][i][1] - s) < 1e-12
    return hits / sum(len(w) for w in want.values())


def test_whole_table_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()], 50, 5)
    assert recall(neighbours.nearest(table, block=256).collect(), want) >= 0.95


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(k, hot if k % 3 == 0 else [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0] * 7 + [None]), (1200, [float("inf")] * 8), (None, hot)]
    frame = spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows + bad], SCHEMA)
    want = brute(rows, 50, 5)
    got = neighbours.nearest(frame, block=64).collect()
    assert recall(got, want) >= 0.95
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 150] == [0, 3, 6, 9, 12]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0, "", "", ""), (1, [2.0, 1.0], 0, "", "", "")], SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
