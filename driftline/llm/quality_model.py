"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass turns each text into a dozen statistics. Random cosines of the standardised statistics
approximate a Gaussian kernel; each partition sums its rows' normal equations, the sums are added
up by key, and only the added matrix, whose size is fixed by the number of features, is solved on
the driver. Raw scores are calibrated by isotonic regression over fixed score bins, which are counted
in Spark. All labelled rows outside the held-out fold are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import common

STATISTICS = ["words", "word_length", "variety", "top_share", "stutter", "symbols", "digits", "capitals", "marks", "dup_lines", "line_words", "high_bytes"]
FEATURES, WIDTH, RIDGE, SEED, BINS = 192, 4.0, 1e-3, 5, 512
_SYMBOLS, _DIGITS, _CAPITALS, _MARKS = b"#*$%&|<>@^~_=+{}[]\\/", b"0123456789", bytes(range(65, 91)), b".,;:!?"
_HIGH = bytes(range(128, 256))


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    left = lambda drop: (size - len(text.translate(None, drop))) / size
    counts: dict[bytes, int] = {}
    get = counts.get
    for w in words:
        counts[w] = get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words[1:], words)) / n
    return [
        float(np.log1p(n)), float(np.log(sum(map(len, words)) / n)), float(np.log(len(counts) / n**0.75)), max(counts.values()) / n, stutter,
        float(np.log1p(50 * left(_SYMBOLS))), float(np.log1p(50 * left(_DIGITS))), left(_CAPITALS) ** 0.5, left(_MARKS) ** 0.5,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), left(_HIGH) ** 0.5,
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and z (array<double>, in the order of STATISTICS) of every row."""

    def run(batches):
        for b in common.pieces(batches):
            z = [statistics_of(t) for t in common.texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.list_(pa.float64()))], names=["doc_id", "z"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, z array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


class Fourier:
    """Cosine features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.maximum(spread, 1e-6)
        self.w = rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, z: np.ndarray) -> np.ndarray:
        x = np.clip((z - self.mean) / self.spread, -8, 8)
        return np.concatenate([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nondecreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            total = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / total if total else max(a[0], b[0]), total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks])


def quality(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, raw of every document.

    Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; repeated label rows count
    once, null or other labels not at all. Null and empty texts have the statistics zero and are
    scored by them. Without labels every score is 0.5. Rows with a null id are scored, their
    ``held_out`` is null; repeated rows stay; other columns are ignored.
    """
    stats = common.cut_lineage(statistics(docs))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(common.remainder(F.col("doc_id"), 5) != 0).distinct()
    p = len(STATISTICS)
    moments = stats.agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(p)], *[F.stddev_pop(F.col("z")[i]).alias(f"s{i}") for i in range(p)]).first()
    mean, spread = (np.array([moments[f"{k}{i}"] or 0.0 for i in range(p)]) for k in "ms")
    fourier = Fourier(mean, spread)
    learned = common.cut_lineage(stats.join(marks, "doc_id").select("z", "y"))

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in common.pieces(batches, 4096):
            if b.num_rows:
                x = fourier(_matrix(b.column(0)))
                total += x.T @ np.concatenate([x, b.column(1).to_numpy(zero_copy_only=False)[:, None]], 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.array(rows.column("row").to_pylist()).sum(0)
        return pa.table({"i": [rows.column("i")[0].as_py()], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kind = "i long, row array<double>"
    equations = learned.mapInArrow(sums, kind).groupBy("i").applyInArrow(add, kind).collect()  # as many rows as features
    weights = np.zeros(FEATURES + 1)
    if equations:
        system = np.array([r.row for r in sorted(equations, key=lambda r: r.i)])
        n = system[-1, -2]
        weights = np.linalg.solve(system[:, :-1] + RIDGE * n * np.diag([*[1.0 / FEATURES] * FEATURES, 1e-9]), system[:, -1])

    def raw(batches):
        for b in common.pieces(batches, 4096):
            r = fourier(_matrix(b.column(1))) @ weights if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r)], names=["doc_id", "raw"])

    bin_of = lambda c: F.least(F.greatest(F.floor((c + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    def raw_of_learned(batches):
        for b in common.pieces(batches, 4096):
            r = fourier(_matrix(b.column(0))) @ weights if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(r), b.column(1)], names=["raw", "y"])

    bins = learned.mapInArrow(raw_of_learned, "raw double, y int").groupBy(bin_of(F.col("raw")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("yes")).collect()  # BINS rows
    count, yes = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        count[r.bin], yes[r.bin] = r.n, r.yes
    used = np.flatnonzero(count)
    if len(used):
        level = isotonic(yes[used] / count[used], count[used])
        curve = np.interp(np.arange(BINS), used, level)
    else:
        curve = np.full(BINS, 0.5)
    steps = F.array(*[F.lit(float(v)) for v in curve])
    scored = stats.mapInArrow(raw, "doc_id long, raw double").withColumn("score", F.get(steps, bin_of(F.col("raw"))))
    return scored.select("doc_id", (common.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "raw")
