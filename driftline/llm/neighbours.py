"""Approximate nearest neighbours by adaptive dimension scans within probed lists.

Vectors are scaled to length one, rotated at random, and stored in inverted lists around centroids
(fitted on a bounded sample; every vector is indexed). A list is cut into blocks of bounded size,
so a hot list is many tasks. A query first meets its own block, which bounds its k-th nearest
distance from above. It then probes each list that the triangle inequality does not rule out by
that bound. Within a block, pairs are scanned in blocks of rotated columns: after s of D columns
the partial distance, scaled by D / s, estimates the whole, and a pair goes if the estimate exceeds
the bound by more than the hypothesis test's margin (1 + EPSILON / sqrt(s)). Survivors are scored
in double precision on the original vectors.

Equal vectors are one entry with their smallest ids: as ties go to smaller ids, no query can need
more than k + 1 of them. Queries travel packed, many to a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm import common
from driftline.llm.hamming import whole_runs
from driftline.llm.substring import _grouped

SAMPLE, MOST_LISTS, BLOCK, PACK = 16_384, 1024, 4096, 256
COLUMNS, EPSILON, SEED = 16, 2.1, 3


def entries(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """copy (hash), ids (the ``keep`` smallest), e (doubles, packed), dim: distinct usable vectors."""

    def run(batches):
        for b in common.pieces(batches, 8192):
            found: dict[bytes, tuple[list[int], bytes, int]] = {}
            for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.array(e, np.float64).tobytes()
                found.setdefault(xxhash.xxh3_128_digest(raw), ([], raw, len(e)))[0].append(i)
            rows = [(k, sorted(ids)[:keep], raw, n) for k, (ids, raw, n) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int32())], names=["copy", "ids", "e", "dim"])

    some = usable(vectors, id_col, vector_col).mapInArrow(run, "copy binary, ids array<long>, e binary, dim int")
    # a group has one row for each task and piece that met it, of at most ``keep`` ids
    return some.groupBy("copy").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.first("e").alias("e"), F.first("dim").alias("dim"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part: id given, no null or non-finite component, not all zero."""
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0.0))


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(rounds):
        of = np.argmax(sample @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    big = np.abs(e).max(1, keepdims=True)
    scaled = e / big
    return e, (scaled / np.linalg.norm(scaled, axis=1, keepdims=True))


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, vector row) that no partial distance has ruled out.

    ``q`` and ``x`` are rotated unit vectors, ``bound`` each query's squared distance to beat.
    """
    dim = x.shape[1]
    a = b = None
    partial = None
    for s in range(0, dim, columns):
        end = min(dim, s + columns)
        if a is None:
            u, v = q[:, s:end], x[:, s:end]
            partial = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (u @ v.T)
        else:
            d = q[a, s:end] - x[b, s:end]
            partial = partial + (d * d).sum(1)
        margin = (1 + epsilon / np.sqrt(end)) ** 2 * (end / dim) if end < dim else 1.0
        if a is None:
            a, b = np.nonzero(partial <= bound[:, None] * margin + 1e-5)
            partial = partial[a, b]
        else:
            kept = partial <= bound[a] * margin + 1e-5
            a, b, partial = a[kept], b[kept], partial[kept]
    return a, b


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; scaled first so that squares neither overflow nor vanish."""
    a, b = (m / np.exp2(np.floor(np.log2(np.abs(m).max(1, keepdims=True)))) for m in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found of each row whose id is divisible by ``every``.

    Rows whose vector is null, zero, or holds a null or non-finite component take no part, nor do
    those with a null id or of a dimension other than the table's most common (ties: the smaller).
    An id that comes twice with different vectors is two candidates. Fewer candidates than k are
    all returned; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    table = common.cut_lineage(entries(vectors, k + 1, id_col, vector_col))
    kind = "query_id long, rank int, vec_id long, score double"
    dims = table.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], kind)
    dim = dims["dim"]
    table = table.where(F.col("dim") == dim).withColumn("vid", F.col("ids")[0])
    n = table.count()
    sample = _unit([r.e for r in table.select("e").orderBy(F.xxhash64("copy")).limit(SAMPLE).collect()])[1]
    lists = int(min(MOST_LISTS, max(1, np.sqrt(n) / 2), len(sample)))
    rotation = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))[0]
    centroids = fit(sample, lists)

    def assign(batches):
        for b in common.pieces(batches, 4096):
            if b.num_rows:
                unit = _unit(b.column(2).to_pylist())[1]
                near = unit @ centroids.T
                of = np.argmax(near, 1)
                angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(of.astype(np.int32)), pa.array(angle)], names=["copy", "ids", "e", "vid", "list", "angle"])

    placed = common.cut_lineage(table.select("copy", "ids", "e", "vid").mapInArrow(assign, "copy binary, ids array<long>, e binary, vid long, list int, angle double"))
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()  # at most MOST_LISTS rows
    blocks, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for r in sizes:
        blocks[r.list], radius[r.list] = -(-r.n // block), r.r
    first = np.concatenate([[0], np.cumsum(blocks)])
    of_list = F.array(*[F.lit(int(v)) for v in first])
    place = F.get(of_list, F.col("list")) + F.pmod(F.xxhash64("copy"), F.get(of_list, F.col("list") + 1) - F.get(of_list, F.col("list")))
    # which entries are queried: those that any querying row shares its vector with
    asked = entries_of_queries(vectors, every, id_col, vector_col)
    keys = common.cut_lineage(asked.select("copy", "query_id"))
    wanted = keys.select("copy").distinct().withColumn("asked", F.lit(True))
    full = placed.join(wanted, "copy", "left").select(place.cast("long").alias("key"), "vid", "ids", "e", F.coalesce("asked", F.lit(False)).alias("asked"))
    full = common.cut_lineage(full.repartition("key").sortWithinPartitions("key"))

    def bounds(batches):
        """Each query's k-th (own entry apart) squared distance within its own block, and the lists it must probe."""
        for key, vid, ids, e, asked_ in whole_runs(batches, 5, 2 * block):
            key = key.to_numpy()
            asked_ = np.asarray(asked_.to_numpy(), bool)
            if not asked_.any():
                continue
            unit = _unit(e.to_pylist())[1]
            vids, raws = vid.to_numpy(), e.to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = i + np.flatnonzero(asked_[i:j])
                for at in range(0, len(mine), PACK):
                    some = mine[at : at + PACK]
                    d = 2 - 2 * (unit[some] @ unit[i:j].T)
                    tau = np.partition(d, k, axis=1)[:, k] if j - i > k else np.full(len(some), 4.0)
                    tau = np.minimum(tau + 1e-6, 4.0)
                    to = np.arccos(np.clip(unit[some] @ centroids.T, -1, 1))
                    least = np.maximum(to - radius - 1e-6, 0)
                    probes = (2 - 2 * np.cos(least) <= tau[:, None]) & (blocks > 0)
                    for target in np.flatnonzero(probes.any(0)).tolist():
                        who = some[probes[:, target]]
                        pack = (vids[who].tobytes(), b"".join(raws[w] for w in who.tolist()), tau[probes[:, target]].tobytes())
                        out = range(int(first[target]), int(first[target + 1]))
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *[pa.array([p] * len(out), pa.binary()) for p in pack]], names=["key", "qv", "qe", "qt"])

    probes = full.select("key", "vid", "ids", "e", "asked").mapInArrow(bounds, "key long, qv binary, qe binary, qt binary")
    stored = full.select("key", F.lit(0).alias("kind"), "vid", "ids", "e", F.lit(None).cast("binary").alias("qv"), F.lit(None).cast("binary").alias("qt"))
    coming = probes.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vid"), F.lit(None).cast("array<long>").alias("ids"), F.col("qe").alias("e"), "qv", "qt")

    def search(batches):
        for rows in _grouped(batches, 0):
            held = [r for r in rows if r[1] == 0]
            if not held:  # chance left the block empty
                continue
            e, unit = _unit([r[4] for r in held])
            x = (unit @ rotation).astype(np.float32)
            ids = [r[3] for r in held]
            for r in rows:
                if r[1] == 0:
                    continue
                qvid, tau = np.frombuffer(r[5], np.int64), np.frombuffer(r[6], np.float64)
                qe = np.frombuffer(r[4], np.float64).reshape(len(qvid), -1)
                qu = _unit([row.tobytes() for row in qe])[1]
                a, b = scan((qu @ rotation).astype(np.float32), x, tau.astype(np.float32))
                score = cosines(qe[a], e[b]) if len(a) else np.zeros(0)
                order = np.lexsort((-score, a))
                a, b, score = a[order], b[order], score[order]
                start = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if len(a) else np.zeros(0, np.int64)
                nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
                # ties with the last place all stay: the smaller id decides later
                last = np.repeat(score[np.minimum(start + k, np.append(start[1:], len(a)) - 1)], np.diff(np.append(start, len(a)))) if len(a) else score
                top = (nth <= k) | (score >= last)
                q, s, v = qvid[a[top]].tolist(), score[top].tolist(), b[top].tolist()
                out = [(i, g, c) for i, c, w in zip(q, s, v, strict=True) for g in ids[w]]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["qvid", "vec_id", "score"])

    found = stored.unionByName(coming).repartition("key").sortWithinPartitions("key", "kind").mapInArrow(search, "qvid long, vec_id long, score double")
    # k + 1 of each queried entry, its own rows among them
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("qvid").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists_of = common.cut_lineage(best.groupBy("qvid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near")))
    back = keys.join(placed.select("copy", "vid"), "copy").join(lists_of, F.col("vid") == F.col("qvid")).select("query_id", "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return back.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def entries_of_queries(vectors: DataFrame, every: int, id_col: str, vector_col: str) -> DataFrame:
    """copy and query_id of the usable rows whose id is divisible by ``every``."""

    def run(batches):
        for b in common.pieces(batches, 8192):
            keys = [xxhash.xxh3_128_digest(np.array(e, np.float64).tobytes()) for e in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0)], names=["copy", "query_id"])

    return usable(vectors, id_col, vector_col).where(F.pmod("id", F.lit(every)) == 0).mapInArrow(run, "copy binary, query_id long")
