import random
import zlib

import numpy as np

from driftline.llm import quality_model as qm

SCHEMA = "doc_id long, text string, y string, z string, raw string"
LABELS = "doc_id long, quality int, toxic int"


def frame(n=400):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(30, 90))]
        good = k % 3 > 0
        if not good:
            words = [w + "$#" for w in words] if k % 2 else [w for w in words[:9] for _ in range(8)]
        rows.append((k, " ".join(words), "", "", ""))
        labels.append((k, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = frame()
    truth = {d: q for d, q, _ in labels}
    out = qm.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_isotonic():
    fit = qm.isotonic(np.array([1.0, 0.0, 2.0, 3.0, 2.0]), np.array([1.0, 3.0, 1.0, 1.0, 1.0]))
    assert fit.tolist() == [0.25, 0.25, 2.0, 2.5, 2.5]


def test_odd_rows(spark):
    rows, labels = frame(60)
    odd = [(None, "a b", "", "", ""), (900, None, "", "", ""), (901, " ", "", "", ""), (902, "é $ " * 20_000, "", "", ""), (3, rows[3][1], "", "", "")]
    out = qm.quality(spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 1), (2, None, 0)], LABELS)).collect()
    assert len(out) == 65 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in qm.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert qm.quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []
