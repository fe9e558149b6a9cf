"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of word shingles link at a few differing bits. The 64 bits are grouped into
partitions, correlated bits together, and each partition i gets its own threshold t_i with
sum(t_i + 1) = t + 1: two fingerprints within t bits must agree within t_i bits in at least one
partition with t_i >= 0. The number of partitions and the thresholds come from dynamic programming
on estimated candidate counts, so they change with the number of fingerprints. The choice only
sets the cost; every choice finds every link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import common, hamming
from driftline.llm.components import components
from driftline.llm.substring import _mix

SEED = 42
BITS = 64
#: Byte values by bit, most significant bit first.
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Cost of a stored or probing row against that of a compared pair.
ROW_COST = 60.0
#: Keys of a shingle set, and least hashed shingles of a key: a pair of similarity 0.8 shares a key in all but 0.04 % of cases.
KEYS, EACH = 20, 5
#: Documents of so many shingles or more are not similar if their fingerprints differ in more bits than this; at similarity 0.8
#: about 10 (standard deviation 3) of the 64 differ, of unlike documents 32 (4).
BITS_FROM, MOST_APART = 20, 26
_FLIP, _ODD = np.random.default_rng(11).integers(0, 1 << 63, (2, KEYS * EACH), dtype=np.uint64)
_ODD |= np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes, as an unsigned number."""
    n = len(hashes)
    at = hashes.astype(">u8").view(np.uint8).reshape(n, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE
    return int.from_bytes(np.packbits((counts.ravel() * 2 > n)).tobytes(), "big")


def shingle_hashes(text: bytes, shingle: int = 3) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; none if it has no word."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    a, e = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return np.array([h(joined[i:j], SEED) for i, j in zip(a, e, strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text's shingles, repeats included; zero if it has no word."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every whole text, in one narrow pass."""

    def run(batches):
        for b in common.pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in common.texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to partitions of even size, each bit to the open one it correlates with most."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0)
    spread = np.sqrt((bits**2).sum(0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(corr, 0)
    size = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    free, groups = set(range(BITS)), []
    for n in size:
        first = max(free, key=lambda b: (corr[b, list(free)].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < n:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _project(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _probes(width: int, t: int) -> int:
    """Values within t bits of a value, itself left out."""
    total, c = 0, 1
    for k in range(1, t + 1):
        c = c * (width - k + 1) // k
        total += c
    return total


def allocate(sample: np.ndarray, rows: int, most: int) -> tuple[list[list[int]], list[int]]:
    """Bit groups and thresholds of least estimated cost, by dynamic programming over the partitions."""
    best: tuple[float, list, list] = (float("inf"), [], [])
    few = sample[:1500]
    i, j = np.triu_indices(len(few), 1)
    for parts in range(1, most + 2):
        groups = bit_groups(sample, parts)
        cost = []
        for g in groups:
            v = _project(few, g)
            d = np.bincount(np.bitwise_count(v[i] ^ v[j]), minlength=BITS + 1) if len(i) else np.zeros(BITS + 1)
            within = np.cumsum(d) / max(1, len(i))
            row = [0.0]  # threshold -1: the partition is not used
            for t in range(most + 1):
                even = (1 + _probes(len(g), t)) / 2.0 ** len(g)
                row.append(rows * ROW_COST * (1 + _probes(len(g), t)) + rows * rows / 2.0 * max(even, float(within[t])))
            cost.append(row)
        spend = most + 1  # what sum(t_i + 1) must come to
        table = [(0.0, [])] + [(float("inf"), [])] * spend
        for row in cost:
            table = [min(((table[s - u][0] + row[u], [*table[s - u][1], u - 1]) for u in range(s + 1)), key=lambda x: x[0]) for s in range(spend + 1)]
        if table[spend][0] < best[0]:
            best = (table[spend][0], groups, table[spend][1])
    return best[1], best[2]


def keyed(fps: DataFrame, groups: list[list[int]], limits: list[int]) -> DataFrame:
    """key, fp, node, probe: a stored row for each used partition, and a probing row for each near value."""
    use = [(k, g, t) for k, (g, t) in enumerate(zip(groups, limits, strict=True)) if t >= 0]

    def run(batches):
        for b in common.pieces(batches, 20_000):
            fp, node = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for k, g, t in use:
                value = _project(fp, g)
                mixed = lambda v, k=k: ((v * np.uint64(0x9E3779B97F4A7C15)) ^ (v >> np.uint64(29)) ^ np.uint64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))).view(np.int64) if len(g) > 58 else ((v << np.uint64(6)) | np.uint64(k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(value)), pa.array(fp.view(np.int64)), pa.array(node), pa.array(np.zeros(len(fp), bool))], names=["key", "fp", "node", "probe"])
                for r in range(1, t + 1):
                    for flip in combinations(range(len(g)), r):
                        mask = np.uint64(sum(1 << x for x in flip))
                        yield pa.RecordBatch.from_arrays([pa.array(mixed(value ^ mask)), pa.array(fp.view(np.int64)), pa.array(node), pa.array(np.ones(len(fp), bool))], names=["key", "fp", "node", "probe"])

    return fps.select("fp", "node").mapInArrow(run, "key long, fp long, node long, probe boolean")


def linked_components(fps: DataFrame, most: int = 3, sample_rows: int = 16_384, block: int = hamming.BLOCK) -> DataFrame:
    """fp, rep (least id with it), component (least id reachable) of every distinct fingerprint.

    Ids that are null are no node: a fingerprint that only such rows have is left out.
    ``sample_rows`` bounds what the driver reads to group bits and estimate costs.
    """
    distinct = common.cut_lineage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    rows = distinct.count()
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], np.int64).view(np.uint64)
    if rows < 2:
        return distinct.select("fp", "rep", F.col("rep").alias("component"))
    groups, limits = allocate(sample, rows, most)
    found = hamming.links(keyed(distinct.select("fp", F.col("rep").alias("node")), groups, limits), most, block)
    of = components(found)
    return distinct.join(of, distinct.rep == of.node, "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable over links) of every row.

    Null and empty texts, and texts of spaces only, have fingerprint zero and link like any other.
    Texts of fewer words than a shingle count as one shingle. Rows with a null id get a fingerprint
    and the component of that fingerprint, if a row with an id has it, else null. Repeated rows are
    all returned. An empty table gives no rows. Other columns are ignored.
    """
    fps = common.cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    classes = linked_components(fps, most)
    return fps.join(classes.select("fp", "component"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _set_of(text: bytes, shingle: int) -> tuple[np.ndarray, int]:
    """A text's distinct shingle hashes, and a hash of them."""
    some = np.unique(shingle_hashes(text, shingle))
    return some, int(_mix(some).sum(dtype=np.uint64).view(np.int64))


def _prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of distinct shingle hashes, zero of an empty one."""
    return np.array([majority(x) if len(x) else 0 for x in sets], np.uint64).view(np.int64)


def _set_keys(some: np.ndarray, rows: int = 4096) -> bytes:
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(some), rows):
        least = np.minimum(least, ((some[at : at + rows, None] ^ _FLIP) * _ODD).min(0))
    parts, key = least.reshape(KEYS, EACH), np.arange(1, KEYS + 1, dtype=np.uint64)
    for k in range(EACH):
        key = _mix(key ^ parts[:, k])
    return key.tobytes()


def similar_documents(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = hamming.BLOCK, with_text_hash: bool = False, most: int = 3) -> DataFrame:
    """doc_id and component_id (least id reachable over links) of every row with an id; with its text_hash if that is asked for.

    Documents link whose sets of word shingles have a Jaccard similarity of at least ``least``; equal sets, empty
    ones too, are one. Candidates are the SimHash components of the sets (``most`` bits, by the generalised pigeonhole principle, as
    in near_duplicates), and, since similar sets may be further apart than any bearable ``most``, those that share a key. Candidates
    that are more than MOST_APART bits apart are dropped; of the others the similarity is computed exactly.
    """

    def first(batches):
        for b in common.pieces(batches):
            out = [_set_of(t, shingle) for t in common.texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for _, h in out], pa.int64()), pa.array(_prints_of([x for x, _ in out])), pa.array([_set_keys(x) if len(x) else b"" for x, _ in out], pa.binary()), b.column(2)], names=["doc_id", "node", "fp", "keys", "text_hash"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    hashed = texts.withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.xxhash64(F.lit(""))))
    every = common.cut_lineage(hashed.mapInArrow(lambda b: common.trimmed(first(b)), "doc_id long, node long, fp long, keys binary, text_hash long"))
    distinct = every.groupBy("node").agg(F.min("doc_id").alias("head"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))

    def exploded(batches):
        for b in common.pieces(batches, 2048):
            keys = [np.frombuffer(k, np.int64) for k in b.column(1).to_pylist()]
            node = np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(node)], names=["key", "node"])

    keyed = distinct.select("node", "keys").mapInArrow(exploded, "key long, node long")
    # keys that bring the same documents together are one
    sets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("node") % F.lit(1 << 40)).cast("decimal(38,0)")).alias("h")).where("n > 1").select("key", F.xxhash64("n", "h").alias("one"))
    near = distinct.select("node", "fp").join(linked_components(distinct.select(F.col("node").alias("doc_id"), "fp"), most, block=block).select("fp", "component"), "fp")
    near = near.select(F.xxhash64("component", F.lit("bits")).alias("key"), "node")
    near = near.join(near.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")
    members = common.cut_lineage(keyed.join(sets, "key").select(F.col("one").alias("key"), "node").unionByName(near).distinct())

    def again(batches):
        for b in common.pieces(batches):
            out = [_set_of(t, shingle) for t in common.texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([h for _, h in out], pa.int64()), pa.array(_prints_of([x for x, _ in out])), pa.array([x.tobytes() for x, _ in out], pa.binary()), b.column(0)], names=["is", "fp", "shingles", "node"])

    wanted = distinct.select("node", "head").join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("head").alias("doc_id"))
    found = texts.join(wanted, "doc_id").select("node", "text").mapInArrow(lambda b: common.trimmed(again(b)), "is long, fp long, shingles binary, node long").where("is = node").select("node", "fp", "shingles").dropDuplicates(["node"])

    def verified(batches):
        for r, p, node, fp, shingles in hamming.whole_runs(batches, 5, 5_000):
            r, p, node, fp = r.to_numpy(), p.to_numpy(), node.to_numpy(), fp.to_numpy().view(np.uint64)
            each = [np.frombuffer(x, np.uint64) for x in shingles.to_pylist()]
            size = np.array([len(x) for x in each])

            def linked(i, j, each=each, size=size, fp=fp):
                fewer = np.minimum(size[i], size[j])
                ok = fewer >= least * np.maximum(size[i], size[j]) - 1e-9
                ok &= (fewer < BITS_FROM) | (hamming.popcount(fp[i] ^ fp[j]) <= MOST_APART)
                for k in np.flatnonzero(ok).tolist():
                    both = len(np.intersect1d(each[i[k]], each[j[k]], assume_unique=True))
                    ok[k] = both >= least * (size[i[k]] + size[j[k]] - both) - 1e-9
                return ok

            a, b = hamming.forest_of_runs(r, p, node, linked)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    pairs = hamming.blocked(members.join(found, "node").select("key", "fp", "node", "shingles"), block).select("run", "part", "node", "fp", "shingles")
    of = components(pairs.repartition("run").sortWithinPartitions("run").mapInArrow(lambda b: common.trimmed(verified(b)), "u long, v long"))
    joined = distinct.select("node", "head").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = joined.groupBy("component").agg(F.min("head").alias("component_id"))
    return every.select("doc_id", "node", "text_hash").join(joined.join(heads, "component").select("node", "component_id"), "node").select("doc_id", "component_id", *(["text_hash"] if with_text_hash else []))


def without_near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar documents the rows with its least id; rows without id stay, all columns stay.

    A row goes if its text is in a component in which another row has a smaller id. Rows that repeat an id are judged each by
    its own text; rows alike in id and text all stay or all go. Null and empty texts are one component. An empty table gives none.
    """
    id_, hash_ = common.fresh(docs, "_id"), common.fresh(docs, "_node")
    tagged = docs.withColumns({id_: docs[id_col].cast("long"), hash_: F.coalesce(F.xxhash64(docs[text_col]), F.xxhash64(F.lit("")))})
    of = similar_documents(docs, least, shingle, id_col, text_col, with_text_hash=True)
    gone = of.where("doc_id <> component_id").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    return tagged.join(gone, [id_, hash_], "left_anti").select(*docs.columns)
