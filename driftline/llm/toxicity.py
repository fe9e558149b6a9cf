"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: a token is labelled toxic if it stands in a toxic document
and one of its features (the word, or its first letters) is found in toxic documents far above its
rate in others. A CRF with tags outside/toxic is trained on those labelled sequences. Its
forward-backward marginals give the offending offsets, and their sum gives the document's score
through a fitted logistic curve.

Training uses a bounded, documented sample of labelled rows, as stretches of at most CHAIN tokens;
scoring reads every whole text once, without shuffle, as one chain however long it is.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import common

#: Bounds of the training sample: documents of either label, and characters of one.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1200, 3600, 10_000
#: Tokens of a training stretch, and of a row in which a whole chain is laid out for scoring.
CHAIN = 64
#: Kept word scores of a worker.
CACHE = 500_000
SPAN_AT = 0.5
_EDGE = b".,;:!?\"'()[]{}"
_FLAT = -30.0


def word_features(word: bytes) -> list[bytes]:
    """Features of a lower-case word: itself and its first letters, edge punctuation left out."""
    w = word.strip(_EDGE)
    s = w.decode("utf-8", "ignore")
    out = [b"w:" + w]
    for n in (3, 4, 5):
        if len(s) > n:
            out.append(f"{n}:{s[:n]}".encode())
    return out


@dataclass
class Crf:
    """Emission weights of the toxic tag against the other, start and transition weights, score curve."""

    weights: dict[bytes, float]
    bias: float
    start: float
    move: np.ndarray  # 2 x 2, from and to
    curve: tuple[float, float]

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in word_features(word))


def forward_backward(e: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic tag, of tag pairs (n, length - 1, 2, 2), and log normalisers, of chains e (n, length)."""
    n, length = e.shape
    m = np.exp(move)
    obs = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    alpha, scale = np.empty((n, length, 2)), np.empty((n, length))
    a = obs[:, 0] * np.array([1.0, np.exp(start)])
    for t in range(length):
        if t:
            a = (alpha[:, t - 1] @ m) * obs[:, t]
        scale[:, t] = a.sum(1)
        alpha[:, t] = a / scale[:, t, None]
    beta = np.ones((n, length, 2))
    for t in range(length - 2, -1, -1):
        beta[:, t] = ((obs[:, t + 1] * beta[:, t + 1]) @ m.T) / scale[:, t + 1, None]
    pairs = alpha[:, :-1, :, None] * m * (obs * beta)[:, 1:, None, :] / scale[:, 1:, None, None]
    return alpha[:, :, 1] * beta[:, :, 1], pairs, np.log(scale).sum(1)


def toxic_marginals(e: np.ndarray, live: np.ndarray, texts: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
    """Marginals of the toxic tag of whole chains that are laid out over rows.

    ``e`` (rows, length) holds emissions, ``live`` says which are real (a chain's last row may be short), and
    chain k is rows texts[k] to texts[k + 1]. A row acts on the two tags' messages as a 2 x 2 matrix, the product of its steps; these
    carry the messages from row to row, and then all rows run side by side from what reaches them.
    """
    rows, length = e.shape
    m = np.exp(move)
    (m00, m01), (m10, m11) = m
    obs = np.exp(np.clip(e, -30, 30))
    into, after = np.full(rows, np.nan), np.ones(rows)  # odds that reach a row from before (none: NaN) and from behind
    several = np.repeat(np.diff(texts) > 1, np.diff(texts))
    if several.any():
        at = np.flatnonzero(several)
        product = np.broadcast_to(np.eye(2), (len(at), 2, 2)).copy()
        for t in range(length):
            on = live[at, t]
            step = product @ m
            step[:, :, 1] *= obs[at, t, None]
            step /= step.sum((1, 2), keepdims=True)
            product[on] = step[on]
        a, b, c, d = (dict(zip(at.tolist(), v.tolist(), strict=True)) for v in product.reshape(-1, 4).T)
        for k in np.flatnonzero(np.diff(texts) > 1).tolist():
            i, j = int(texts[k]), int(texts[k + 1])
            r = float(obs[i, 0] * np.exp(start))
            for x in obs[i, 1:].tolist():
                r = x * (m01 + r * m11) / (m00 + r * m10)
            for n in range(i + 1, j):
                into[n] = r
                r = (b[n] + r * d[n]) / (a[n] + r * c[n])
            r = 1.0
            for n in range(j - 1, i, -1):
                r = (c[n] + r * d[n]) / (a[n] + r * b[n])
                after[n - 1] = r
    ahead = np.empty((length, rows))
    r = obs[:, 0] * np.where(np.isnan(into), np.exp(start), (m01 + into * m11) / (m00 + into * m10))
    ahead[0] = r
    for t in range(1, length):
        r = obs[:, t] * (m01 + r * m11) / (m00 + r * m10)
        ahead[t] = r
    out = np.empty((rows, length))
    back = after
    for t in range(length - 1, -1, -1):
        if t < length - 1:
            q = obs[:, t + 1] * back
            back = np.where(live[:, t + 1], (m10 + q * m11) / (m00 + q * m01), back)
        odds = ahead[t] * back
        out[:, t] = odds / (1 + odds)
    return out


def chains(values: np.ndarray, begins: np.ndarray, length: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat values of several texts over padded rows of one length; each value's row and column, and where each text's rows begin."""
    size = np.diff(begins)
    rows_of = -(-size // length)
    first = np.concatenate([[0], np.cumsum(rows_of)])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], size)
    row, col = np.repeat(first[:-1], size) + at // length, at % length
    out = np.full((int(first[-1]), length), _FLAT)
    out[row, col] = values
    return out, row, col, first


def lexicon(texts: list[list[bytes]], toxic: list[bool]) -> set[bytes]:
    """Features far more frequent in toxic documents than in others.

    An occurrence counts once for each pair of neighbours, so that the copies of a text add nothing.
    """
    number: dict[bytes, int] = {}
    streams = ([], [])
    for words, label in zip(texts, toxic, strict=True):
        streams[bool(label)].extend([number.setdefault(w, len(number)) + 1 for w in words])
        streams[bool(label)].append(0)
    per_word, totals = [], []
    for stream in streams:
        x = np.array([0, *stream, 0], np.uint64)
        context = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[2:]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[1:-1]
        _, first = np.unique(context, return_index=True)
        ids = x[1:-1][first].astype(np.int64)
        counts = np.bincount(ids, minlength=len(number) + 1)
        per_word.append(counts)
        totals.append(max(1, int(counts[1:].sum())))
    counts = (Counter(), Counter())
    for w, k in number.items():
        for f in word_features(w):
            for y in (0, 1):
                if c := int(per_word[y][k + 1]):
                    counts[y][f] += c
    least = max(3, 0.005 * sum(toxic))
    return {f for f, c in counts[1].items() if c >= least and c / totals[1] >= 20 * (counts[0][f] + 0.5) / totals[0]}


def train(texts: list[bytes], toxic: list[bool], rounds: int = 12, batch: int = 1024, seed: int = 11) -> Crf:
    """Fits the CRF and the score curve; with a single class the score is that class's rate."""
    one: dict[bytes, bytes] = {}  # equal words share an object
    words = [[one.setdefault(w, w) for w in t.lower().split()] for t in texts]
    if not texts or not any(toxic) or all(toxic):
        rate = (sum(toxic) + 0.5) / (len(toxic) + 1.0) if texts else 0.5
        return Crf({}, -20.0, 0.0, np.zeros((2, 2)), (float(np.log(rate / (1 - rate))), 0.0))
    signs = lexicon(words, toxic)
    cache: dict[bytes, tuple[list[bytes], bool]] = {}
    rows = []  # chains of (word, label)
    rng = np.random.default_rng(seed)
    for ws, label in zip(words, toxic, strict=True):
        for at in range(0, len(ws), CHAIN):
            part = ws[at : at + CHAIN]
            tags = []
            for w in part:
                if w not in cache:
                    f = word_features(w)
                    cache[w] = (f, any(x in signs for x in f))
                tags.append(label and cache[w][1])
            if any(tags) or rng.random() < (0.15 if label else 0.08):
                rows.append((part, tags))
    seen = Counter(f for part, _ in rows for w in part for f in cache[w][0])
    index = {f: k + 1 for k, f in enumerate(sorted(f for f, c in seen.items() if c >= 3))}  # 0: none of the known
    known = {w: np.array([index.get(f, 0) for f in fs] + [0] * (4 - len(fs))) for w, (fs, _) in cache.items()}
    ids = np.zeros((len(rows), CHAIN, 4), np.int32)
    tag, mask = np.zeros((len(rows), CHAIN)), np.zeros((len(rows), CHAIN))
    for k, (part, tags) in enumerate(rows):
        ids[k, : len(part)] = [known[w] for w in part]
        tag[k, : len(part)], mask[k, : len(part)] = tags, 1
    w = np.zeros(len(index) + 1)
    b, start, move = -3.0, 0.0, np.zeros((2, 2))
    sums = [np.full(len(w), 1e-6), 1e-6, 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(rounds):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            x, y, on = ids[pick], tag[pick], mask[pick]
            e = np.where(on > 0, (w[x[..., 0]] + w[x[..., 1]] + w[x[..., 2]] + w[x[..., 3]]) + b, _FLAT)
            p, pairs, _ = forward_backward(e, start, move)
            gap = (y - p) * on / len(pick)
            gw = np.bincount(x.ravel(), np.repeat(gap.ravel(), 4), minlength=len(w)) - 1e-4 * w
            gw[0] = 0
            both = on[:, 1:, None, None] * np.stack([np.stack([(1 - y[:, :-1]) * (1 - y[:, 1:]), (1 - y[:, :-1]) * y[:, 1:]], 2), np.stack([y[:, :-1] * (1 - y[:, 1:]), y[:, :-1] * y[:, 1:]], 2)], 2)
            gm = (both - on[:, 1:, None, None] * pairs).sum((0, 1)) / len(pick) - 1e-3 * move
            gs = ((y - p)[:, 0] * on[:, 0]).mean()
            for k, g in enumerate((gw, gap.sum(), gs, gm)):
                sums[k] = sums[k] + g * g
            w = w + 0.5 * gw / np.sqrt(sums[0])
            b = b + 0.3 * gap.sum() / np.sqrt(sums[1])
            start = start + 0.2 * gs / np.sqrt(sums[2])
            move = move + 0.2 * gm / np.sqrt(sums[3])
    model = Crf({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-6}, float(b), float(start), move, (0.0, 1.0))
    x, y = np.log(evidence(words, model) + 1e-3), np.array(toxic, float)
    a = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(30):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(h, design.T @ (y - p) - 1e-2 * a)
    model.curve = (float(a[0]), float(a[1]))
    return model


_scores: dict[bytes, float] = {}
_scored_by: list = [None]


def _marginals(words: list[list[bytes]], model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginals of all words, one text after another, and where each text begins."""
    if _scored_by[0] is not model or len(_scores) > CACHE:
        _scores.clear()
        _scored_by[0] = model
    get, emission = _scores.get, model.emission
    flat, begins = [], [0]
    for ws in words:
        for w in ws:
            v = get(w)
            if v is None:
                v = _scores[w] = emission(w)
            flat.append(v)
        begins.append(len(flat))
    begins = np.array(begins)
    if not flat:
        return np.zeros(0), begins
    e, row, col, first = chains(np.array(flat), begins)
    live = np.zeros(e.shape, bool)
    live[row, col] = True
    return toxic_marginals(e, live, first, model.start, model.move)[row, col], begins


def _sums(p: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the squared marginals: every token counts, and many faint ones stay faint."""
    total = np.concatenate([[0.0], np.cumsum(p * p)])
    return np.maximum(total[begins[1:]] - total[begins[:-1]], 0.0)


def evidence(words: list[list[bytes]], model: Crf) -> np.ndarray:
    out = [_sums(*_marginals(words[at : at + 256], model)) for at in range(0, len(words), 256)]
    return np.concatenate(out) if out else np.zeros(0)


def training_sample(docs: DataFrame, labels: DataFrame, fold: int, held: int, label: str, most: tuple[int, int], chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> list:
    """(text, label) rows: at most so many of label 0 and of label 1, those least by hash of the id.

    Rows whose id is null, whose crc32 modulo ``fold`` is ``held``, or whose text is longer than
    ``chars`` are not drawn; a null text is empty. A repeated label row counts once.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("i"), labels[label].cast("int").alias("y")).where("i is not null and y in (0, 1)").where(common.remainder(F.col("i"), fold) != held).distinct()
    # the least hashes are found on ids alone; the texts join only those
    few = [marks.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(3 * n) for y, n in enumerate(most)]
    texts = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("t")).where(F.length("t") <= chars)
    rows = texts.join(F.broadcast(few[0].unionByName(few[1])), "i")  # at most 3 * sum(most) rows of two numbers
    rows = rows.withColumn("o", F.xxhash64("i"))
    out = []
    for y, n in enumerate(most):
        out += [(r.t.encode(), y) for r in rows.where(F.col("y") == y).orderBy("o", "i", "t").limit(n).collect()]
    return out


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_spans, offsets of every row.

    ``offsets`` lists begin and end (code points, end excluded) of each toxic span. A null or empty
    text scores what no evidence scores and has no span. Null ids and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of the bounded sample

    def run(batches):
        m = sent.value
        for b in common.pieces(batches, 256):
            texts = common.texts_of(b.column(1))
            words = [t.lower().split() for t in texts]
            p, begins = _marginals(words, m)
            x = np.log(_sums(p, begins) + 1e-3)
            s = 1 / (1 + np.exp(-np.clip(m.curve[0] + m.curve[1] * x, -40, 40)))
            offsets, counts = [], []
            hot = p >= SPAN_AT
            any_hot = np.concatenate([[0], np.cumsum(hot)])
            for k, t in enumerate(texts):
                i, j = begins[k], begins[k + 1]
                if any_hot[j] == any_hot[i]:
                    offsets.append([])
                    counts.append(0)
                    continue
                points = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
                places, last = [], -2
                for n, found in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", t)):
                    if hot[i + n]:
                        begin, end = int(points[found.start()]), int(points[found.end()])
                        if last == n - 1:
                            places[-1] = end
                        else:
                            places += [begin, end]
                        last = n
                offsets.append(places)
                counts.append(len(places) // 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(counts, pa.int64()), pa.array(offsets, pa.list_(pa.int32()))], names=["doc_id", "score", "n_spans", "offsets"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, n_spans long, offsets array<int>")


def toxicity(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, offsets of every document.

    Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2. Without any usable label
    every score is 0.5. A document that is labelled both ways is learned from once for each label. ``held_out`` is null where the id is.
    """
    sample = training_sample(docs, labels, 4, 2, "toxic", (CLEAN_DOCS, TOXIC_DOCS))
    model = train([t for t, _ in sample], [bool(y) for _, y in sample])
    out = score(docs, model)
    return out.select("doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "n_spans", "offsets")
