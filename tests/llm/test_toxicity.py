import itertools
import random
import re
import zlib

import numpy as np

from driftline.llm import toxicity as tx

SCHEMA = "doc_id long, text string, toxic string, score string, offsets string"
LABELS = "doc_id long, quality int, toxic int"


def test_forward_backward_against_all_taggings():
    rng = np.random.default_rng(0)
    e, start, move = rng.normal(size=(3, 5)), 0.4, rng.normal(size=(2, 2))
    p, pairs, logz = tx.forward_backward(e, start, move)
    for i in range(3):
        z, mine, two = 0.0, np.zeros(5), np.zeros((4, 2, 2))
        for tags in itertools.product((0, 1), repeat=5):
            w = np.exp(start * tags[0] + sum(e[i, k] for k in range(5) if tags[k]) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
            z += w
            mine += w * np.array(tags)
            for k in range(4):
                two[k, tags[k], tags[k + 1]] += w
        assert np.allclose(p[i], mine / z) and np.allclose(pairs[i], two / z) and np.isclose(logz[i], np.log(z))
    assert np.allclose(tx.toxic_marginals(e, np.ones(e.shape, bool), np.arange(4), start, move), p)


def test_whole_texts_are_one_chain():
    """Texts of any length, laid out over rows, against forward-backward over each text alone."""
    rng = np.random.default_rng(1)
    start, move = -0.7, rng.normal(size=(2, 2))
    sizes = [0, 1, 4, 5, 6, 10, 11, 333, 1]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.normal(scale=2, size=begins[-1])
    e, row, col, first = tx.chains(values, begins, 5)
    live = np.zeros(e.shape, bool)
    live[row, col] = True
    got = tx.toxic_marginals(e, live, first, start, move)[row, col]
    for i, j in zip(begins[:-1], begins[1:]):
        if j > i:
            assert np.allclose(got[i:j], tx.forward_backward(values[None, i:j], start, move)[0][0])


def test_scores_are_those_of_the_marginals(spark):
    """Score and offsets of every document from forward-backward over its whole chain, by plain code."""
    rows, labels = frame(spark, 160)
    rows.append((500, " ".join(r[1] for r in rows), "", "", ""))
    rows.append((501, "é zorg, 😀  zorgling!\tÄ quxxab", "", "", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = tx.train([r[1].encode() for r in rows[:160]], [bool(y) for _, _, y in labels])
    for r, (_, text, *_) in zip(sorted(tx.score(docs, model).collect(), key=lambda r: r.doc_id), rows, strict=True):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        e = np.array([[model.emission(x.group().encode().lower()) for x in found]])
        p = tx.forward_backward(e, model.start, model.move)[0][0]
        s = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log((p * p).sum() + 1e-3))))
        assert abs(s - r.score) < 1e-9
        spans, last = [], -2
        for n in np.flatnonzero(p >= tx.SPAN_AT).tolist():
            if last == n - 1:
                spans[-1] = found[n].end()
            else:
                spans += [found[n].start(), found[n].end()]
            last = n
        assert spans == r.offsets


def frame(spark, n=400):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(3, 6)))
    rows, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randint(20, 60))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["zorg", "zorgling!", "Quxxa" + word()])
        rows.append((k, " ".join(words), "1", "", ""))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = frame(spark)
    out = tx.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    truth, texts = {d: t for d, _, t in labels}, {r[0]: r[1] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and len(r.offsets) == 2 * r.n_spans
        for a, b in zip(r.offsets[::2], r.offsets[1::2]):
            assert any(w in texts[r.doc_id][a:b].lower() for w in ("zorg", "quxxa"))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = frame(spark, 120)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    a, b = ({r.doc_id: r.score for r in tx.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    rows, labels = frame(spark, 80)
    odd = [(None, "zorg", "", "", ""), (900, None, "", "", ""), (901, "", "", "", ""), (902, "é zorg " * 9000, "", "", ""), (3, rows[3][1], "", "", "")]
    marks = [*labels, (1, 1, 0), (None, 1, 1), (2, None, None)]
    out = tx.toxicity(spark.createDataFrame(rows + odd, SCHEMA), spark.createDataFrame(marks, LABELS)).collect()
    assert len(out) == 85 and all(0 <= r.score <= 1 for r in out)
    none = tx.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert tx.toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []
