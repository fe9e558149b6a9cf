"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of the packed stream should hold each source in its target proportion. Documents
are dealt evenly to buckets; within a bucket each source has a queue, and each window raises every
source's deficit by its target share of the window. Sources are then served in turn, up to their
deficit, documents being cut where a window or a deficit ends; what a source could not supply or
spend stays in its deficit for the next window. A bucket starts from the deficits that the buckets
before it leave behind. Those depend only on each bucket's token totals by source, so a running sum
over totals carries them across buckets and all buckets are packed at once.

Nothing is padded but what a length cannot avoid: the last, short window of a bucket is cut into
sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm import bpe, common

WINDOW = 2048
END_ID = 1
#: A source is served once its deficit is this many tokens, so that pieces do not become tiny.
LEAST_PIECE = 64
#: Tokens of a bucket, about; a task holds the ids of one.
BUCKET_TOKENS = 1_000_000
MOST_BUCKETS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, n, ids (little-endian 16-bit, or 32-bit where an id needs it) of every document."""

    def run(batches):
        c = bpe.codec(path, bpe.LibraryCodec)
        wide = len(c.names) > 1 << 16
        for b in common.pieces(batches, 256):
            texts = bpe.strings_of(b.column(1))
            ids, begins = c.encode_batch(texts)
            raw = memoryview(np.ascontiguousarray(ids, "<u4" if wide else "<u2")).cast("B") if len(ids) else memoryview(b"")
            end = np.array([END_ID], "<u4" if wide else "<u2").tobytes()
            at = (begins * (4 if wide else 2)).tolist()
            packed = [bytes(raw[i:j]) + end for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(begins) + 1), pa.array(packed, pa.binary())], names=["doc_id", "source", "n", "ids"])

    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"))
    return kept.mapInArrow(lambda b: common.trimmed(run(b)), "doc_id long, source string, n long, ids binary")


def carried(totals: DataFrame, whole: int, targets: dict[str, float] | None = None) -> DataFrame:
    """bucket, source, share, deficit: the deficits with which each bucket starts.

    ``totals`` has bucket, source, n; ``whole`` is the sum of all n. After the buckets before it a source is owed its share of all
    their tokens, less its own. Shares are the given targets, or the whole input's. The running
    sums sort one row for each bucket (and source); there are at most MOST_BUCKETS.
    """
    if targets is None:
        sources = totals.groupBy("source").agg((F.sum("n") / F.lit(float(max(whole, 1)))).alias("share"))
    else:
        share = F.create_map([F.lit(x) for kv in targets.items() for x in kv])[F.col("source")] if targets else F.lit(0.0)
        sources = totals.select("source").distinct().select("source", F.coalesce(share.cast("double"), F.lit(0.0)).alias("share"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    alls = totals.groupBy("bucket").agg(F.sum("n").alias("all")).select("bucket", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    of_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select("bucket", "source", F.coalesce(F.sum("n").over(of_source), F.lit(0)).alias("own"))
    return own.join(alls, "bucket").join(sources, "source").select("bucket", "source", "share", (F.col("share") * F.col("before") - F.col("own")).alias("deficit"))


class Queue:
    """Documents of one source that wait, with the place reached in the first."""

    __slots__ = ("at", "docs", "left", "place")

    def __init__(self):
        self.docs, self.at, self.place, self.left = [], 0, 0, 0

    def add(self, doc: int, n: int) -> None:
        self.docs.append((doc, n))
        self.left += n

    def take(self, most: int) -> tuple[int, int, int]:
        """doc, start, length of the next piece."""
        doc, n = self.docs[self.at]
        start = self.place
        length = min(most, n - start)
        self.place += length
        self.left -= length
        if self.place == n:
            self.at, self.place = self.at + 1, 0
        return doc, start, length


def fill(queues: dict[str, Queue], shares: dict[str, float], deficits: dict[str, float], window: int = WINDOW, least: int = LEAST_PIECE):
    """Pieces (doc, start, length, sequence, offset) of all that waits; changes the deficits.

    Each window's tokens are those of the sources that are owed most, served in turn by deficit; a
    window that the owed sources cannot fill takes the rest from the largest deficits that still
    have documents. The rest of the last window becomes power-of-two sequences.
    """
    left = sum(q.left for q in queues.values())
    order = sorted(queues)
    sequence = 0
    while left:
        if left >= window:
            room = size = window
        else:
            room = size = 1 << (left.bit_length() - 1)
        for s in order:
            deficits[s] += shares[s] * size
        for last in (False, True):
            turn = sorted((s for s in order if queues[s].left), key=lambda s: -deficits[s])
            for s in turn:
                q = queues[s]
                owed = room if last else int(deficits[s])
                if not last and owed < min(least, q.left):
                    continue
                grant = min(owed, room, q.left)
                while grant > 0:
                    doc, start, length = q.take(grant)
                    yield doc, start, length, sequence, size - room
                    grant -= length
                    room -= length
                    left -= length
                    deficits[s] -= length
                if not room:
                    break
            if not room:
                break
        sequence += 1


def pack(docs: DataFrame, targets: dict[str, float] | None = None, path: str | None = None, bucket_tokens: int = BUCKET_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece of a document in a sequence of at most 2048 tokens.

    A null or empty text is its end token alone. Null sources are the source ''. Rows with a null
    id are packed like others; repeated rows are packed each. Very long texts are cut over as
    many windows as they need. An empty table gives no rows; other columns are ignored.
    Without ``targets`` each source's share of all tokens is its target.
    """
    path = path or common.tokenizer_path()
    width = "<u4" if len(bpe.codec(path, bpe.LibraryCodec).names) > 1 << 16 else "<u2"
    tok = tokens(docs, path, id_col, text_col, source_col)
    tok = common.cut_lineage(tok.withColumn("spread", F.xxhash64("doc_id", "n", F.monotonically_increasing_id())))
    whole = tok.agg(F.sum("n")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-whole // bucket_tokens)))
    tok = tok.withColumn("bucket", F.pmod("spread", F.lit(buckets)).cast("int"))
    totals = common.cut_lineage(tok.groupBy("bucket", "source").agg(F.sum("n").alias("n")))
    no = F.lit(None)
    starts = carried(totals, whole, targets).select("bucket", F.lit(0).alias("kind"), no.cast("long").alias("spread"), no.cast("long").alias("doc_id"), "source", no.cast("long").alias("n"), no.cast("binary").alias("ids"), "share", "deficit")
    rows = tok.select("bucket", F.lit(1).alias("kind"), "spread", "doc_id", "source", "n", "ids", no.cast("double").alias("share"), no.cast("double").alias("deficit"))

    def bucket_of(bucket: int, start: list[dict], docs_: list[tuple]):
        queues = {s["source"]: Queue() for s in start}
        shares = {s["source"]: s["share"] for s in start}
        deficits = {s["source"]: s["deficit"] for s in start}
        ids = []
        for k, (_, source, n, raw) in enumerate(docs_):
            queues[source].add(k, n)
            ids.append(np.frombuffer(raw, width).astype("<u4").tobytes())
        out = [[] for _ in range(7)]
        first = bucket << 32
        for k, start_, length, sequence, offset in fill(queues, shares, deficits):
            doc, _, n, _ = docs_[k]
            for column, v in zip(out, (doc, start_, length, zlib.crc32(ids[k][4 * start_ : 4 * (start_ + length)]), n, first + sequence, offset), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        now, start, held = None, [], []
        for b in batches:
            for bucket, kind, _, doc, source, n, raw, share, deficit in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now:
                    if held:
                        yield bucket_of(now, start, held)
                    now, start, held = bucket, [], []
                if kind:
                    held.append((doc, source, n, raw))
                else:
                    start.append({"source": source, "share": share, "deficit": deficit})
        if held:
            yield bucket_of(now, start, held)

    return rows.unionByName(starts).repartition("bucket").sortWithinPartitions("bucket", "kind", "spread").mapInArrow(lambda b: common.trimmed(run(b)), SCHEMA)
