"""Substring deduplication with difference-cover anchors.

A window is ``length`` (50) consecutive words of one document; a word goes if a window covers it
whose word sequence also starts in a document with a smaller id. Hashing all windows would mean one
row for each word of the corpus. Instead only anchors are hashed: windows of
``length - period + 1`` words that start at places whose remainder modulo the period lies in a
difference cover. For any two places i and j there is a shift d < period with both i + d and j + d
in the cover, so two equal windows share an equal anchor at the same shift. Documents whose anchors
occur nowhere else are done; around shared anchors the match is extended to whole windows, whose
hashes decide.

Both rounds (anchors, then windows) exchange hashes the same way. A task gathers some thousand
documents (a flush) and settles among them what it can: a hash that a flush holds many times leaves
it as one entry, so a passage that a third of all documents share costs one entry a flush. Entries
travel in packed arrays, by hash bucket; there the hashes of all flushes meet, and answers go back to
the flush, whose table names the documents. No pair of documents is ever a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import common

LENGTH = 50
#: Every remainder modulo PERIOD is a difference of two members of COVER.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Kept word hashes of a worker; the cache is emptied when it is full.
CACHE = 250_000
_words: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    common.claim("words", _words.clear)
    if len(_words) > CACHE:
        _words.clear()
    get, h = _words.get, xxhash.xxh64_intdigest
    out = []
    for w in words:
        v = get(w)
        if v is None:
            v = _words[w] = h(w, 7)
        out.append(v)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """Powers of the base or its inverse modulo 2**64, kept and extended."""
    have = _powers[which]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have), 32_768), _BASE if which == "up" else _INVERSE, np.uint64)
        base[0] = 1
        have = _powers[which] = np.multiply.accumulate(base)
    return have[:n]


class Rolling:
    """Hashes of any windows of one text, from prefix sums of its word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n = n
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _power("up", n), dtype=np.uint64)])
        self.down = _power("down", n + 1)

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.prefix[starts + length] - self.prefix[starts]) * self.down[starts] + np.uint64(length))


def anchor_starts(n: int, length: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Cover places at which an anchor fits."""
    size = length - period + 1
    if n < length:
        return np.zeros(0, np.int64)
    blocks = np.arange(0, n, period)[:, None] + np.array(cover)
    starts = np.sort(blocks.ravel())
    return starts[starts <= n - size]


#: A flush has about so many entries; entries of a flush fit in a task's memory.
FLUSH = 800_000
#: A flush has at most so many words (or one document), so that 32 bits count its places.
FLUSH_WORDS = 1 << 28
#: Bytes of text whose hashes meet in a bucket, about: with a hash for each 5 words a bucket has some million entries.
BUCKET_BYTES = 64 << 20
_EXCHANGE = "key long, kind int, flush long, a binary, b binary, c binary"
_NAMES = ["key", "kind", "flush", "a", "b", "c"]
TABLE, ENTRY, ANSWER = 0, 1, 2


class _Flush:
    """Hashes of some documents, gathered until there are enough."""

    def __init__(self, buckets: int, windows: bool):
        from pyspark import TaskContext

        self.buckets, self.windows = buckets, windows
        context = TaskContext.get()
        self.number = (context.partitionId() if context else 0) << 24
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.owners, self.places = [], [], []
        self.ids, self.texts, self.begins, self.words, self.entries = [], [], [], 0, 0

    def add(self, doc: int, text: int, n: int, hashes: np.ndarray, starts: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.owners.append(np.full(len(hashes), doc))
        self.places.append(self.words + starts)
        self.ids.append(doc)
        self.texts.append(text)
        self.begins.append(self.words)
        self.words += n
        self.entries += len(hashes)

    def rows(self):
        """The exchange's rows: the flush's table, its entries by bucket, and what is settled here."""
        if not self.ids:
            return
        h, doc, place = np.concatenate(self.hashes), np.concatenate(self.owners), np.concatenate(self.places)
        order = np.lexsort((place, doc, h))
        h, doc, place = h[order], doc[order], place[order]
        new_run = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new_group = new_run | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(h) else new_run
        run = np.cumsum(new_run) - 1
        groups_of_run = np.bincount(run[new_group], minlength=int(run[-1]) + 1 if len(run) else 0)
        many = groups_of_run[run] > 1
        first_of_run = np.flatnonzero(new_run)
        if self.windows:  # only the least document's windows are open
            open_ = doc == doc[first_of_run][run] if len(h) else many
            settled = place[~open_]
            entry = first_of_run
            entry_place = place[entry]
        else:  # an anchor of several documents is shared; the others need to know of it only
            open_ = ~many
            settled = place[many]
            entry = first_of_run
            entry_place = np.where(many[entry], -1, place[entry])
        extra = np.flatnonzero(open_ & ~new_run)
        twins = np.stack([place[first_of_run[run[extra]]], place[extra]]) if len(extra) else np.zeros((2, 0), np.int64)
        number = self.number
        table = np.stack([np.array(self.ids, np.int64), np.array(self.texts, np.int64), np.array(self.begins, np.int64)])
        out = [(number % self.buckets, TABLE, number, table.tobytes(), twins.astype(np.int64).tobytes(), b"")]
        if len(settled):
            out.append((number % self.buckets, ANSWER, number, settled.astype(np.int32).tobytes(), b"", b""))
        bucket = (h[entry] % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.lexsort((entry_place, bucket))  # by place, so that differences are small and owners come in runs
        ends = np.searchsorted(bucket[by_bucket], np.arange(self.buckets + 1))
        for k in range(self.buckets):
            at = entry[by_bucket[ends[k] : ends[k + 1]]]
            if len(at):
                p = entry_place[by_bucket[ends[k] : ends[k + 1]]].astype(np.int32)
                out.append((k, ENTRY, number, h[at].tobytes(), np.diff(p, prepend=np.int32(0)).tobytes(), _runs(doc[at]).tobytes() if self.windows else b""))
        self.number += 1
        self._clear()
        yield _batch(out)


def _runs(x: np.ndarray) -> np.ndarray:
    """Values and lengths of runs of equal values."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return np.stack([x[at], np.diff(np.append(at, len(x)))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=_NAMES)


def _grouped(batches, key: int):
    """Lists of rows with the same key; rows arrive sorted by it."""
    now, held = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[key] != now and held:
                yield held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield held


def _meet(batches, windows: bool):
    """Hashes of all flushes meet in their bucket; answers to the flushes whose entries are hit."""
    for rows in _grouped(batches, 0):
        yield _batch([r for r in rows if r[1] != ENTRY] or [])
        entries = [r for r in rows if r[1] == ENTRY]
        if not entries:
            continue
        h = np.concatenate([np.frombuffer(r[3], np.uint64) for r in entries])
        place = np.concatenate([np.cumsum(np.frombuffer(r[4], np.int32), dtype=np.int32) for r in entries])
        flush = np.repeat([r[2] for r in entries], [len(r[3]) // 8 for r in entries])
        doc = np.concatenate([np.repeat(*np.frombuffer(r[5], np.int64).reshape(2, -1)) for r in entries]) if windows else flush
        order = np.lexsort((doc, h))
        h, place, flush, doc = h[order], place[order], flush[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        run, first = np.cumsum(new) - 1, np.flatnonzero(new)
        if windows:
            hit = doc > doc[first][run]
        else:
            size = np.diff(np.append(first, len(h)))
            hit = ((size > 1)[run]) & (place >= 0)
        flush, place = flush[hit], place[hit]
        by = np.argsort(flush, kind="stable")
        flush, place = flush[by], place[by]
        at = np.flatnonzero(np.concatenate([[True], flush[1:] != flush[:-1]])) if len(flush) else np.zeros(0, np.int64)
        yield _batch([(r, ANSWER, int(flush[i]), place[i:j].tobytes(), b"", b"") for r, i, j in zip(range(len(at)), at.tolist(), [*at[1:].tolist(), len(flush)], strict=False)])


def _hits(batches):
    """doc_id, text, places: the answers of each flush, by its table."""
    for rows in _grouped(batches, 2):
        table = next(r for r in rows if r[1] == TABLE)
        ids, texts, begins = np.frombuffer(table[3], np.int64).reshape(3, -1)
        twins = np.frombuffer(table[4], np.int64).reshape(2, -1)
        answers = [np.frombuffer(r[3], np.int32) for r in rows if r[1] == ANSWER]
        if not answers:
            continue
        hit = np.concatenate(answers).astype(np.int64)
        hit = np.unique(np.concatenate([hit, twins[1][np.isin(twins[0], hit)]]))
        of = np.searchsorted(begins, hit, "right") - 1
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        docs_ = of[at]
        places = [(hit[i:j] - begins[o]).astype(np.int32).tobytes() for o, i, j in zip(docs_.tolist(), at.tolist(), [*at[1:].tolist(), len(hit)], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[docs_]), pa.array(texts[docs_]), pa.array(places, pa.binary())], names=["doc_id", "text_hash", "places"])


def _exchange(rows: DataFrame, windows: bool) -> DataFrame:
    """doc_id, text_hash, places of the documents that have hits."""
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: common.trimmed(_meet(b, windows)), _EXCHANGE)
    back = met.repartition("flush").sortWithinPartitions("flush").mapInArrow(lambda b: common.trimmed(_hits(b)), "doc_id long, text_hash long, places binary")
    return back.groupBy("doc_id", "text_hash").agg(F.first("places").alias("places"))


def removed_windows(texts: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, flush: int = FLUSH) -> DataFrame:
    """doc_id, text_hash, places: the starts (packed 32-bit) of each document's removed windows.

    ``texts`` has doc_id (not null), text_hash and text. Rows that repeat an id are documents of
    their own, but windows never remove those of the same id.
    """
    size = length - period + 1
    buckets = common.buckets_for(texts, "text", BUCKET_BYTES)

    def anchors(batches):
        f = _Flush(buckets, windows=False)
        for b in common.pieces(batches):
            for doc, text_hash, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts_of(b.column(2)), strict=True):
                words = t.split()
                if len(words) >= length:
                    starts = anchor_starts(len(words), length, period, cover)
                    f.add(doc, text_hash, len(words), Rolling(word_hashes(words)).windows(starts, size), starts)
                    if f.entries >= flush or f.words >= FLUSH_WORDS:
                        yield from f.rows()
        yield from f.rows()

    def extend(batches):
        f = _Flush(buckets, windows=True)
        for b in common.pieces(batches):
            for doc, text_hash, t, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = t.split()
                n, hit = len(words), np.frombuffer(places, np.int32)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, np.maximum(hit + size - length, 0), 1)
                np.add.at(step, hit + 1, -1)
                starts = np.flatnonzero(np.cumsum(step)[: n - length + 1] > 0)
                f.add(doc, text_hash, n, Rolling(word_hashes(words)).windows(starts, length), starts)
                if f.entries >= flush or f.words >= FLUSH_WORDS:
                    yield from f.rows()
        yield from f.rows()

    shared = _exchange(texts.select("doc_id", "text_hash", "text").mapInArrow(lambda b: common.trimmed(anchors(b), _words.clear), _EXCHANGE), windows=False)
    near = texts.join(shared, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "places")
    return _exchange(near.mapInArrow(lambda b: common.trimmed(extend(b), _words.clear), _EXCHANGE), windows=True)


def _covered(places: bytes | None, n: int, length: int) -> np.ndarray | None:
    """Which words removed windows cover."""
    if places is None:
        return None
    step, at = np.zeros(n + 1, np.int64), np.frombuffer(places, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:n]) > 0


def _with_windows(docs: DataFrame, id_col: str, text_col: str, length: int, period: int, cover: tuple[int, ...], flush: int) -> tuple[DataFrame, str]:
    """The rows, and the name of a further column: the places of removed windows, null where nothing goes."""
    id_, hash_, places = (common.fresh(docs, n) for n in ("_id", "_hash", "_places"))
    tagged = docs.withColumns({id_: docs[id_col].cast("long"), hash_: F.xxhash64(docs[text_col])})
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null and text is not null").withColumn("text_hash", F.xxhash64("text"))
    gone = removed_windows(texts, length, period, cover, flush).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("places").alias(places))
    return tagged.join(gone, [id_, hash_], "left").drop(id_, hash_), places


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null, empty and short texts lose nothing. A row with a null id takes no part and keeps all its
    words. Rows that repeat an id do not remove each other's words. An empty table gives no rows;
    other columns are ignored.
    """

    def run(batches):
        for b in common.pieces(batches):
            out = [[], [], []]
            for t, places in zip(common.texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = t.split()
                gone = _covered(places, len(words), length)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for column, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows, places = _with_windows(docs.select(id_col, text_col), id_col, text_col, length, period, cover, flush)
    return rows.select(F.col(id_col).cast("long"), text_col, places).mapInArrow(lambda b: common.trimmed(run(b)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, flush: int = FLUSH) -> DataFrame:
    """The documents with the removed words cut from their texts; all rows and columns stay.

    A text that loses words becomes its kept words joined by one space, other texts stay as they
    are. Nulls and repeats as in kept_digests.
    """

    def one(t: str, places: bytes) -> str:
        words = t.encode().split()
        gone = _covered(places, len(words), length)
        return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()

    @F.pandas_udf("string")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else one(t, p) for t, p in zip(text, places, strict=True)], dtype=object)

    rows, places = _with_windows(docs, id_col, text_col, length, period, cover, flush)
    return rows.withColumn(text_col, cut(text_col, places)).select(*docs.columns)
