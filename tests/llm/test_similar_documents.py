import pytest

import corpus_pipeline
from driftline.llm import simhash


def brute(rows, least=0.8):
    """Components of all pairs by exact Jaccard similarity of 5-word shingles."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) - 1e-9:
                x, y = sorted((find(d), find(e)))
                parent[y] = x
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("block", [2, 2048])
def test_against_brute_force_jaccard(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs, block=block).collect()} == want
    if block > 2:
        kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, None).collect()]
        assert sorted(kept) == sorted(set(want.values()))
        # 2 and 56, at 0.967, did not link by 3 bits
        assert want[2] == want[56]
