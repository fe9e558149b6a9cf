import hashlib
import random

import duckdb
import pytest

from driftline.llm import queries, substring

SCHEMA = "doc_id long, text string, text_hash long, places string, _id string"


def brute(rows, length):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - length + 1):
                if least[tuple(w[i : i + length])] < d:
                    gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    m, c = substring.PERIOD, substring.COVER
    assert {(a - b) % m for a in c for b in c} == set(range(m))


@pytest.mark.parametrize("flush", [40, 10**6])
def test_small_windows_against_brute_force(spark, flush):
    rnd = random.Random(5)
    base = [rnd.choice("abc") for _ in range(300)]
    rows = []
    for k in range(60):
        i = rnd.randrange(250)
        rows.append((rnd.randrange(1000), " ".join(rnd.choices("abcdefgh", k=rnd.randrange(30)) + base[i : i + rnd.randrange(60)] + rnd.choices("abcdefgh", k=rnd.randrange(30)))))
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], rows[2][1]), (None, rows[3][1]), (5000, rows[3][1]), (5001, ""), (5002, None), (5003, "x " * 500), (5004, "x " * 400)]
    docs = spark.createDataFrame([(*r, 1, "", "z") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, substring.kept_digests(docs, length=10, period=7, cover=(1, 2, 4), flush=flush).collect()), key=str)
    assert got == brute(rows, 10)
    cut = substring.without_repeats(docs, length=10, period=7, cover=(1, 2, 4), flush=flush)
    assert cut.columns == docs.columns
    texts = sorted(((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()), key=str)
    assert texts == sorted(((d, h) for d, _, _, h in got), key=str)


def test_empty(spark):
    assert substring.kept_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_against_sql(spark):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op9_substring_dedup"]).fetchall())
    got = sorted(map(tuple, queries.QUERIES["op9_substring_dedup"](spark, data).collect()))
    assert got == want and sum(r[2] for r in got) > 0
