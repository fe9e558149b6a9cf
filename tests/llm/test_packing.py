import zlib

import numpy as np
import pytest

from driftline.llm import common, packing

DATA = "/root/testdata/sf0.01"


def check(rows, docs):
    """Every id lies in exactly one piece; sequences have no gap and no needless padding."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(common.tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack(docs, bucket_tokens=200_000).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    # the first bucket owes nothing from before: until queues run dry its windows hold the shares
    total, share = sum(r.length for r in rows), {}
    for r in rows:
        share[source[r.doc_id]] = share.get(source[r.doc_id], 0) + r.length / total
    mine = [r for r in rows if r.sequence_id < 30]
    held = {s: sum(r.length for r in mine if source[r.doc_id] == s) / sum(r.length for r in mine) for s in share}
    assert sum(abs(held[s] - share[s]) for s in share) < 0.1


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, n long, ids string, bucket string"
    rows = [(1, None, None, None, None, None), (2, "", "a", 1, "x", "y"), (3, "word " * 20_000, "a", 1, "x", "y")]
    check(packing.pack(spark.createDataFrame(rows, schema)).collect(), [r[:2] for r in rows])
    twice = packing.pack(spark.createDataFrame([(7, "a b", "s", 1, "", "")] * 2 + [(None, "c", "s", 1, "", "")], schema)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice if r.start == 0)[0][0] == 0 and sum(r.length for r in twice) == 8
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("carry", [0.0, 700.0])
def test_deficits_carry(carry):
    queues = {"a": packing.Queue(), "b": packing.Queue()}
    for k in range(40):
        queues["a"].add(k, 1000)
        queues["b"].add(100 + k, 1000)
    deficits = {"a": carry, "b": -carry}
    pieces = list(packing.fill(queues, {"a": 0.75, "b": 0.25}, deficits))
    first = sum(p[2] for p in pieces if p[3] == 0 and p[0] < 100)
    assert abs(first - min(2048, 1536 + carry)) <= packing.LEAST_PIECE
    over = sum(p[2] for p in pieces if p[3] < 10 and p[0] < 100)
    assert abs(over - (15360 + carry)) <= packing.LEAST_PIECE
