"""Nothing of the training documents is left out."""

import math
import random
import zlib

import numpy as np

from driftline.llm import language_model as lm


def test_mixture_covers_all_training_words(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=14))
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0]
    train = [d for d in range(400) if d not in held][:90]
    words = [word() for _ in range(90 * 3000)]
    assert len(set(words)) > 1 << 18
    rows = [(d, " ".join(words[3000 * k : 3000 * k + 3000])) for k, d in enumerate(train)] + [(held[0], " ".join(rnd.sample(words, 200)))]
    got = [r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) == 1 and got[0].n_known == 201
    assert got[0].score >= 201 * math.log10(lm.MIX / len(words) * 0.99)


def _docs(spark, texts):
    train = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 10]
    return spark.createDataFrame(list(zip(train, texts, strict=False)), "doc_id long, text string")


def test_every_training_document_is_trained_on(spark, monkeypatch):
    seen, load_mean = [], lm.Attention.load_mean
    monkeypatch.setattr(lm.Attention, "load_mean", lambda self, total, blocks: (seen.append(blocks), load_mean(self, total, blocks)))
    got = lm.scores(_docs(spark, ["some words of text " * (k % 7 + 1) for k in range(100)])).collect()
    assert seen == [sum(-(-(r.n_symbols + 1) // lm.STRIDE) for r in got)]


def test_first_steps_use_all_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Attention, "train", lambda self, x, *rest: seen.append(len(x)))
    got = lm.scores(_docs(spark, ["a " * 7900] * 28)).collect()
    assert seen == [sum(-(-(r.n_symbols + 1) // lm.STRIDE) for r in got)] and seen[0] > 12_000


def test_classes_come_from_all_training_documents(spark, monkeypatch):
    seen, classes_of = [], lm.classes_of
    monkeypatch.setattr(lm, "classes_of", lambda counts, size: (seen.append(counts), classes_of(counts, size))[1])
    # the long document is in no sample
    got = lm.scores(_docs(spark, ["some words", "other " * 9000])).collect()
    assert np.sum(seen[0]) == sum(r.n_symbols for r in got)
