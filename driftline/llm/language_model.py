"""Language-model scores from a causal self-attention model over subword ids, trained in numpy.

A text is its words (A-Z lower) and an end. Subwords come from a published vocabulary; the last
subword of a word is a symbol of its own, so a symbol sequence spells exactly one word sequence.
The probability of a symbol is that of its class, given the context, times that of the symbol
within its class:

* within the class: smoothed counts, given the symbol before, over all training documents;
* of the class: a softmax of its log frequencies given the symbol before, over all training
  documents, plus the output of one layer of causal self-attention, trained first on a bounded sample on the driver and
  then by every task on all of its own training documents, the results being averaged.

A word's probability mixes its symbols' product and its frequency in all training documents,
which comes with the unigram base's counts.

Scoring cuts a text's symbols into blocks of STRIDE. A block attends to itself and the block
before it: windows of 2 * STRIDE overlap by half, each symbol is scored once, and a task's windows run
as one masked batch.

A task gathers some thousand documents (a flush) into one compressed table: the documents' words as
numbers, and the symbols of each distinct word, once. All passes read these tables. The unigram base
needs each word's count over all training documents: a flush's distinct words are packed by hash
bucket, counts meet there, and answers go back to the flush, where base and model are scored together.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import bpe, common
from driftline.llm.substring import _grouped, _mix

STRIDE, WIDTH, HIDDEN = 16, 16, 32
SINGLE, SHARED = 96, 31
END_CLASS = SINGLE + SHARED
CLASSES = END_CLASS + 1
BEGIN = CLASSES  # an input only
#: Symbols that are told apart as the one before: the most frequent, two rests, and the begin.
FINE = 768
FINE_IN = FINE + 3
#: Training documents and characters that the driver reads for its first steps.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 8000
SMOOTH = 0.1
#: Weight of a class's own distribution against what followed the symbol before.
PRIOR = 10.0
#: Weight of the words' frequencies in the mixture.
MIX = 0.3
#: Tokens of a flush, about, and bytes of text for each hash bucket.
FLUSH, BUCKET_BYTES = 750_000, 32 << 20
#: Words that are expanded to symbols together, about.
PIECE = 50_000
TABLE, ENTRY, ANSWER, TOTAL = 0, 1, 2, 4
_KIND = "key long, kind int, flush long, a binary, b binary, c binary"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _KIND.split(", ")]
_END_WORD = b" end"
#: A word's pieces, and the space between words.
_PIECES = regex.compile(bpe.SPLIT.pattern + "| ")
_SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: What a document is to the training.
TRAINS, HELD, NO_ID = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


def _squeezed(x: np.ndarray) -> bytes:
    """An int32 array, compressed by bytes of like weight."""
    planes = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _spread(raw: bytes) -> np.ndarray:
    """The array of _squeezed."""
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


_codecs: dict[str, bpe.Codec] = {}


def _release() -> None:
    """Lets go of the kept encodings, which the later passes over a worker's documents do not need."""
    _codecs.clear()


class Symbols:
    """Symbols of texts: subword id, plus the vocabulary's size if the subword ends a word."""

    def __init__(self, path: str):
        if path not in _codecs:
            _codecs[path] = bpe.LibraryCodec(path)  # its kept chunks are this class's words
        self.codec = _codecs[path]
        self.size = len(self.codec.names)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols one after another, and where each text begins."""
        c = self.codec
        if len(c.chunk_cache) > bpe.CACHE // 2:
            c._reset()
        number, begins, get = [], [0], c.chunk_cache.get
        for t in texts:
            # the words' own boundaries: the codec's white space is wider, so each word is a chunk
            words = b" ".join(t.lower().split()).decode().split(" ")
            self._plain_words([w for w in dict.fromkeys(words) if w.isascii() and w.isprintable() and w not in c.chunk_cache and w])
            for w in words:
                if w:
                    n = get(w)
                    number.append(self._word(w) if n is None else n)
            begins.append(len(number))
        number = np.array(number, np.int64)
        offsets, flat = np.frombuffer(c.offsets, np.int64), np.frombuffer(c.flat, np.uint32) if c.flat else np.zeros(0, np.uint32)
        first = offsets[number]
        size = offsets[number + 1] - first
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        out = flat[at].astype(np.int64)
        out[ends[1:][size > 0] - 1] += self.size
        return out, ends[np.array(begins)]

    def _plain_words(self, words: list[str]) -> None:
        """Keeps the symbols of words of printable ASCII, all at once; each of them has a piece."""
        if not words:
            return
        c = self.codec
        get, word = c.word_cache.get, c._word
        ids = [() if p == " " else get(p) or word(p) for p in _PIECES.findall(" ".join(words))]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        between = np.flatnonzero(size == 0)
        upto = np.append(np.cumsum(size)[between], size.sum()) + len(c.flat)
        c.chunk_cache.update(zip(words, range(len(c.offsets) - 1, len(c.offsets) - 1 + len(words)), strict=True))
        c.flat.extend(chain.from_iterable(ids))
        c.offsets.extend(upto.tolist())

    def _word(self, w: str) -> int:
        c = self.codec
        first = len(c.flat)
        c.flat.extend([i for part in c._chunks(w) for piece in bpe.SPLIT.findall(part) for i in c._word(piece)])
        if len(c.flat) == first:  # a word of characters that the vocabulary drops
            c.flat.append(0)
        number = c.chunk_cache[w] = len(c.offsets) - 1
        c.offsets.append(len(c.flat))
        return number


class _Gathered:
    """Documents gathered until they have enough words, and the rows they become."""

    def __init__(self, buckets: int, symbols: Symbols):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.buckets, self.symbols, self.number = buckets, symbols, (context.partitionId() if context else 0) << 24
        self._clear()

    def _clear(self) -> None:
        self.docs, self.states, self.texts, self.tokens = [], [], [], 0

    def add(self, doc: int | None, held: bool | None, text: bytes) -> None:
        self.docs.append(0 if doc is None else doc)
        self.states.append(NO_ID if held is None else HELD if held else TRAINS)
        self.texts.append(text.lower())
        self.tokens += sum(map(text.count, _SPACES)) + 2  # the words and the end, at most

    def _numbered(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Each document's number of words with its end, their numbers in the order of first appearance after the end's, and the distinct words."""
        split = pc.ascii_split_whitespace(pa.array(self.texts, pa.binary()).cast(pa.large_string()))
        kept = pc.greater(pc.binary_length(split.values), 0)  # white space before and after the words leaves empty ones
        words = split.values.filter(kept).dictionary_encode()
        before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
        ends = before[split.offsets.to_numpy()]
        size = np.diff(ends) + 1
        word = np.zeros(ends[-1] + len(size), np.int32)
        inner = np.ones(len(word), bool)
        inner[np.cumsum(size) - 1] = False
        word[inner] = words.indices.to_numpy() + 1
        return size.astype(np.int32), word, [_END_WORD, *words.dictionary.cast(pa.large_binary()).to_pylist()]

    def rows(self):
        """The flush's table, and its distinct words' hashes and training counts by bucket."""
        if not self.docs:
            return
        size, word, distinct = self._numbered()
        state = np.array(self.states, np.int8)
        # numbers by falling frequency are small; the end stays the first
        often = np.bincount(word, minlength=len(distinct))
        often[0] = len(word) + 1
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        word, distinct = place[word], [distinct[k] for k in order.tolist()]
        count = np.bincount(word, weights=np.repeat(state == TRAINS, size), minlength=len(distinct)).astype(np.int32)
        symbols, _ = self.symbols.encode([b" ".join(distinct[1:])])
        out = [(0, TABLE, self.number, np.array(self.docs, np.int64).tobytes() + size.tobytes() + state.tobytes(), _squeezed(word), _squeezed(symbols))]
        hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in distinct], np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        ends = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = order[i:j]
            out.append((int(bucket[i]), ENTRY, self.number, hashes[at].tobytes(), count[at].tobytes(), at.astype(np.int32).tobytes()))
        self.number += 1
        self._clear()
        yield _rows(out)


class Table:
    """A flush's documents: their ids, states and sizes, their words, and the symbols of each distinct word."""

    def __init__(self, a: bytes, b: bytes, c: bytes, size: int):
        n = len(a) // 13
        self.ids, self.sizes, self.states = np.frombuffer(a, np.int64, n), np.frombuffer(a, np.int32, n, 8 * n), np.frombuffer(a, np.int8, n, 12 * n)
        self.word, self.flat = _spread(b), _spread(c).astype(np.int64)
        ends = np.concatenate([[0, 0], np.flatnonzero(self.flat >= size) + 1])  # the end has no symbol
        self.first, self.length = ends[:-1], np.diff(ends)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    def symbol_counts(self, size: int) -> np.ndarray:
        """Counts of the training documents' symbols."""
        times = np.bincount(self.word, weights=np.repeat(self.states == TRAINS, self.sizes), minlength=len(self.length)).astype(np.int64)
        return np.bincount(self.flat, weights=np.repeat(times, self.length), minlength=2 * size).astype(np.int64)

    def pieces(self, training: bool = False):
        """Numbers of some documents, all or those that train, and the symbols of each."""
        docs = np.flatnonzero(self.states == TRAINS) if training else np.arange(len(self.ids))
        cuts = np.flatnonzero(np.diff(np.cumsum(self.sizes[docs], dtype=np.int64) // PIECE)) + 1
        for some in np.split(docs, cuts):
            if len(some):
                yield some, [self.symbols(self.word[self.begins[d] : self.begins[d + 1]]) for d in some.tolist()]

    def symbols(self, word: np.ndarray) -> np.ndarray:
        n = self.length[word]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[word] - (ends - n), n) + np.arange(ends[-1])]


def _tables(batches, size: int):
    for b in batches:
        for a, w, c in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
            yield Table(a, w, c, size)


def gathered(docs: DataFrame, fold: int, held: int, path: str, id_col: str, text_col: str, flush: int) -> DataFrame:
    """One pass over the texts: the flushes' tables and the exchange's rows."""
    buckets = common.buckets_for(docs, text_col, BUCKET_BYTES)

    def run(batches):
        words = _Gathered(buckets, Symbols(path))
        for b in common.pieces(batches, 256):
            for doc, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), common.texts_of(b.column(1)), strict=True):
                words.add(doc, h, t)
                if words.tokens >= flush:
                    yield from words.rows()
        yield from words.rows()

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return d.withColumn("held", common.remainder(F.col("doc_id"), fold) == held).mapInArrow(lambda b: common.trimmed(run(b)), _KIND)


def _met(batches):
    """Total training counts of a bucket's words, and an answer to each flush."""
    for entries in _grouped(batches, 0):
        h = np.concatenate([np.frombuffer(r[3], np.uint64) for r in entries])
        n = np.concatenate([np.frombuffer(r[4], np.int32) for r in entries])
        unique, of = np.unique(h, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, of, n)
        out, at = [(0, TOTAL, 0, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes(), b"", b"")], 0
        for r in entries:
            m = len(r[3]) // 8
            out.append((0, ANSWER, r[2], total[of[at : at + m]].tobytes(), r[5], b""))
            at += m
        yield _rows(out)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def _by_class(of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class; those of no class are left out."""
    out = np.zeros((CLASSES + 2, rows.shape[1]), rows.dtype)
    small = of.astype(np.uint8)
    size = np.bincount(small, minlength=CLASSES + 2)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(rows[np.argsort(small, kind="stable")], np.cumsum(size)[some] - size[some])
    return out[:-1]


class Attention:
    """One layer of causal self-attention over symbol classes, with a hidden layer, added to pair log frequencies."""

    NAMES = ("e", "q", "k", "v", "rel", "w1", "b1", "w2")

    def __init__(self, pairs: np.ndarray):
        rng = np.random.default_rng(9)
        d, h = WIDTH, HIDDEN
        total = pairs.sum(0) + 1.0
        uni = total / total.sum()
        self.pairs = np.log((pairs + 20.0 * uni) / (pairs.sum(1, keepdims=True) + 20.0)).astype(np.float32)
        normal = lambda *s, scale: (rng.normal(size=s) * scale).astype(np.float32)
        self.p = {"e": normal(CLASSES + 1, d, scale=0.3), "q": normal(d, d, scale=d**-0.5), "k": normal(d, d, scale=d**-0.5), "v": normal(d, d, scale=d**-0.5), "rel": np.zeros(2 * STRIDE, np.float32), "w1": normal(2 * d, h, scale=(2 * d) ** -0.5), "b1": np.zeros(h, np.float32), "w2": normal(h, CLASSES, scale=0.02)}
        t, s = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None]
        self.back = np.clip(t - s, 0, 2 * STRIDE - 1)
        self.future = np.where(s > t, np.float32(-1e9), np.float32(0))

    @staticmethod
    def blocks(seqs: list[np.ndarray], befores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, 2 * STRIDE), -1 where there is none, targets (n, STRIDE), -1 likewise, the symbols before, and each block's text."""
        size = np.array([len(s) for s in seqs])
        count = -(-size // STRIDE)
        of = np.repeat(np.arange(len(seqs)), count)
        first = np.concatenate([[0], np.cumsum(count)])
        y = np.full((int(first[-1]), STRIDE), -1, np.int64)
        x = np.full((int(first[-1]), STRIDE), -1, np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, col = np.repeat(first[:-1], size) + at // STRIDE, at % STRIDE
        flat = np.concatenate([*seqs, np.zeros(0, np.int64)]).astype(np.int64)
        y[row, col] = flat
        x[row, col] = np.where(at == 0, BEGIN, np.concatenate([[BEGIN], flat[:-1]]))
        fine = np.full((int(first[-1]), STRIDE), FINE_IN - 1, np.int64)
        fine[row, col] = np.concatenate([*befores, np.zeros(0, np.int64)])
        before = np.full_like(x, -1)
        before[1:] = x[:-1]
        before[first[:-1]] = -1
        return np.concatenate([before, x], 1), y, fine, of

    def _lookups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention scores of class pairs, values and hidden inputs of classes, a row (and column) more where there is no symbol.

        What depends on classes alone is computed once for each class. Scores are shifted to be 0 at most.
        """
        p = self.p
        e, n = p["e"], CLASSES + 1
        score = np.zeros((n + 1, n + 1), np.float32)
        score[:n, :n] = (e @ p["q"]) @ (e @ p["k"]).T * np.float32(WIDTH**-0.5)
        score[:n, :n] -= score[:n, :n].max(1, keepdims=True)
        score[:n, n] = -1e9
        value, hidden = np.zeros((n + 1, WIDTH), np.float32), np.zeros((n + 1, HIDDEN), np.float32)
        value[:n], hidden[:n] = e @ p["v"], e @ p["w1"][:WIDTH] + p["b1"]
        return score, value, hidden

    def forward(self, x: np.ndarray, fine: np.ndarray, keep: bool = False, tables=None):
        p = self.p
        score, value, hidden = tables or self._lookups()
        n = CLASSES + 1
        ids = np.where(x < 0, n, x)
        cur = ids[:, STRIDE:]
        pair = (cur * (n + 1))[:, :, None] + ids[:, None, :]
        s = score.ravel().take(pair)
        s += (p["rel"] - p["rel"].max())[self.back] + self.future
        if score.diagonal().min() + p["rel"][0] - p["rel"].max() < -60:  # else exp leaves each symbol's weight of itself
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= (s @ _ones(2 * STRIDE))[:, :, None]
        v = value.take(ids, axis=0)
        c = (s @ v).reshape(-1, WIDTH)
        z = c @ p["w1"][WIDTH:]
        z += hidden.take(cur.ravel(), axis=0)
        np.maximum(z, 0, out=z)
        logits = z @ p["w2"]
        logits += self.pairs.take(fine.ravel(), axis=0)
        if len(z) and not (logits.max() < 60 and logits[:, 0].min() > -57):  # else exp neither overflows nor loses a row
            logits -= logits.max(1, keepdims=True)
        return (logits, (ids, cur, pair, v, s, c, z)) if keep else logits

    def log_probs(self, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> np.ndarray:
        """Natural log probability of each block's targets, in the shape of y, 0 where there is none."""
        out = np.zeros(y.shape)
        step = 64  # blocks whose logits stay in cache
        tables = self._lookups()
        for at in range(0, len(x), step):
            logits = self.forward(x[at : at + step], fine[at : at + step], tables=tables)
            target = np.maximum(y[at : at + step].ravel(), 0)
            chosen = logits[np.arange(len(logits)), target].astype(np.float64)
            np.exp(logits, out=logits)
            out[at : at + step] = (chosen - np.log((logits @ _ones(CLASSES)).astype(np.float64))).reshape(-1, STRIDE)
        return np.where(y >= 0, out, 0.0)

    def gradients(self, x: np.ndarray, y: np.ndarray, fine: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, CLASSES + 1
        d, (ids, cur, pair, v, a, c, z) = self.forward(x, fine, keep=True)
        on = (y.ravel() >= 0).astype(np.float32)
        on /= max(1.0, float(on.sum()))
        np.exp(d, out=d)
        d *= (on / (d @ _ones(CLASSES)))[:, None]
        d[np.arange(len(d)), np.maximum(y.ravel(), 0)] -= on
        g = {"w2": (d.T @ z).T}
        dz = d @ p["w2"].T
        dz *= z > 0
        dc = (dz @ p["w1"][WIDTH:].T).reshape(len(x), STRIDE, WIDTH)
        ds = dc @ v.transpose(0, 2, 1)
        ds *= a
        ds -= a * (ds @ _ones(2 * STRIDE))[:, :, None]
        g["rel"] = np.bincount(self.back.ravel(), ds.sum(0).ravel(), minlength=2 * STRIDE).astype(np.float32)
        dscore = np.bincount(pair.ravel(), ds.ravel(), minlength=(n + 1) ** 2).reshape(n + 1, n + 1)[:n, :n].astype(np.float32)
        dscore *= np.float32(WIDTH**-0.5)
        e = p["e"]
        of = {"q": dscore @ (e @ p["k"]), "k": dscore.T @ (e @ p["q"]), "v": _by_class(ids.ravel(), (a.transpose(0, 2, 1) @ dc).reshape(-1, WIDTH))}
        dhidden = _by_class(cur.ravel(), dz)
        g["b1"] = dhidden.sum(0)
        g["w1"] = np.concatenate([e.T @ dhidden, c.T @ dz])
        g["e"] = dhidden @ p["w1"][:WIDTH].T
        for name, table in of.items():
            g[name] = e.T @ table
            g["e"] += table @ p[name].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, fine: np.ndarray, rounds: int, rate: float, batch: int = 128) -> None:
        """Adam steps over shuffled blocks."""
        rng = np.random.default_rng(4)
        now = self.vector()
        m, u = np.zeros_like(now), np.zeros_like(now)
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                g, step = self.gradients(x[some], y[some], fine[some]), step + 1
                g = np.concatenate([g[n].ravel() for n in self.NAMES])
                m += np.float32(0.1) * (g - m)
                u += np.float32(0.001) * (g * g - u)
                now -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(u * np.float32(1 / (1 - 0.999**step))) + np.float32(1e-8))
                self.load(now)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.NAMES])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            size = self.p[n].size
            self.p[n] = vector[at : at + size].reshape(self.p[n].shape).astype(np.float32)
            at += size

    def load_mean(self, total: np.ndarray, blocks: float) -> None:
        """Parameters from their sum over so many blocks."""
        self.load(total / blocks)


def classes_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and fine number of each symbol: the most frequent alone, the others shared by end of word (and number)."""
    order = np.argsort(-counts, kind="stable")
    half = SHARED // 2
    out = SINGLE + np.where(np.arange(2 * size) >= size, half + np.arange(2 * size) % (SHARED - half), np.arange(2 * size) % half)
    out[order[:SINGLE]] = np.arange(SINGLE)
    fine = FINE + (np.arange(2 * size) >= size)
    fine[order[:FINE]] = np.arange(FINE)
    return out, fine


def word_begins(seqs: list[np.ndarray], size: int) -> np.ndarray:
    """Where each word of each text (its end too) begins in the texts' symbols with ends."""
    flat = np.concatenate([np.append(s, 2 * size) for s in seqs])
    return np.concatenate([[0], np.flatnonzero(flat >= size)[:-1] + 1])


def scores(docs: DataFrame, fold: int = 10, held: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_symbols of every row.

    Trained on the rows whose crc32(doc_id) modulo ``fold`` is not ``held``; rows with a null id are
    scored but not trained on, their ``held_out`` is null. Null and empty texts are the end alone.
    Repeated rows train and are scored each. An empty table gives no rows; other columns are ignored.
    Without training rows counts are zero and classes are even.
    """
    path = path or common.tokenizer_path()
    size = len(bpe.codec(path, bpe.LibraryCodec).names)
    rows = common.cut_lineage(gathered(docs, fold, held, path, id_col, text_col, flush))
    tables = rows.where(F.col("kind") == TABLE).select("a", "b", "c")

    def drawn(batches):
        """Of each flush the training documents that the sample may hold: those of least hash."""
        _release()
        for t in _tables(batches, size):
            n = np.add.reduceat(t.length[t.word], t.begins[:-1])
            may = np.flatnonzero((t.states == TRAINS) & (n <= SAMPLE_CHARS))
            h = _mix(t.ids[may].view(np.uint64)).view(np.int64)
            least = np.lexsort((t.ids[may], h))[:SAMPLE_DOCS]
            texts = [t.symbols(t.word[t.begins[d] : t.begins[d + 1]]).astype(np.int32).tobytes() for d in may[least].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(h[least]), pa.array(t.ids[may[least]]), pa.array(texts, pa.binary())], names=["h", "doc_id", "symbols"])

    sample = [np.frombuffer(r.symbols, np.int32).astype(np.int64) for r in tables.mapInArrow(drawn, "h long, doc_id long, symbols binary").orderBy("h", "doc_id", "symbols").limit(SAMPLE_DOCS).collect()]
    kind = "i long, n long"

    def summed(counted, length: int) -> np.ndarray:
        """Sum of the tasks' count vectors of this length."""
        total = np.zeros(length)
        counts = tables.mapInArrow(counted, kind).groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as the vector is long
        total[counts.column("i").to_numpy()] = counts.column("n").to_numpy()
        return total

    def symbols(batches):
        """Counts of the training documents' symbols."""
        _release()
        total = np.zeros(2 * size, np.int64)
        for t in _tables(batches, size):
            total += t.symbol_counts(size)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["i", "n"])

    single = summed(symbols, 2 * size)
    class_of, fine_of = classes_of(single, size)
    of_class, of_pair = FINE_IN * CLASSES, FINE_IN * FINE

    def sequences(seqs: list[np.ndarray]):
        """Each text's classes with the end, and the fine symbol before each."""
        return [np.append(class_of[s], END_CLASS) for s in seqs], [np.append(FINE_IN - 1, fine_of[s]) for s in seqs]

    def counted(batches):
        """Counts of the training documents: of (symbol before, class), and after them of (symbol before, symbol)."""
        _release()
        total = np.zeros(of_class + of_pair, np.int64)
        for t in _tables(batches, size):
            for _, seqs in t.pieces(training=True):
                classes, before = map(np.concatenate, sequences(seqs))
                fine = np.concatenate([np.append(fine_of[s], FINE) for s in seqs])
                total[:of_class] += np.bincount(before * CLASSES + classes, minlength=of_class)
                told = (fine < FINE) & (classes >= SINGLE)  # within a class of one symbol there is nothing to tell
                total[of_class:] += np.bincount((before * FINE + fine)[told], minlength=of_pair)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["i", "n"])

    pairs, within = np.split(summed(counted, of_class + of_pair), [of_class])
    inside = (single + SMOOTH) / np.bincount(class_of, single + SMOOTH, minlength=CLASSES)[class_of]
    pairs, within = pairs.reshape(FINE_IN, CLASSES), within.reshape(FINE_IN, FINE)
    of_fine = np.full(FINE, END_CLASS)
    of_fine[fine_of[fine_of < FINE]] = class_of[fine_of < FINE]
    in_class = np.stack([np.bincount(of_fine, row, minlength=CLASSES) for row in within])

    def within_class(s: np.ndarray, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log probability of each symbol within its class, given the symbol before."""
        fine = fine_of[s]
        seen = np.where((fine < FINE) & (classes >= SINGLE), within[before, np.minimum(fine, FINE - 1)], 0.0)
        return np.log((seen + PRIOR * inside[s]) / (in_class[before, classes] + PRIOR))

    model = Attention(pairs)
    if sample:
        x, y, fine, _ = Attention.blocks(*sequences(sample))
        model.train(x, y, fine, 8, 6e-3)

    def local(batches):
        """The task's own steps over its training documents, and their number of blocks."""
        seqs, mine = [], Attention(pairs)
        mine.load(model.vector())
        done = 0
        for t in _tables(batches, size):
            for _, more in t.pieces(training=True):
                seqs += more
                if sum(map(len, seqs)) > 200_000:
                    x, y, fine, _ = Attention.blocks(*sequences(seqs))
                    mine.train(x, y, fine, 1, 1e-3)
                    seqs, done = [], done + len(x)
        if seqs:
            x, y, fine, _ = Attention.blocks(*sequences(seqs))
            mine.train(x, y, fine, 1, 1e-3)
            done += len(x)
        if done:
            v = mine.vector().astype(np.float64) * done
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v) + 1)), pa.array(np.append(v, done))], names=["i", "v"])

    found = tables.mapInArrow(local, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # as many rows as parameters
    if found:
        v = np.array([r.v for r in sorted(found, key=lambda r: r.i)])
        model.load_mean(v[:-1], v[-1])

    met = common.cut_lineage(rows.where(F.col("kind") == ENTRY).repartition("key").sortWithinPartitions("key").mapInArrow(_met, _KIND))

    def totals(batches):
        t = np.zeros(2, np.int64)
        for b in common.pieces(batches):
            for a in b.column(0).to_pylist():
                t += np.frombuffer(a, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(t[:1]), pa.array(t[1:])], names=["n", "v"])

    whole = met.where(F.col("kind") == TOTAL).select("a").mapInArrow(totals, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    scale = float(np.log10(n + SMOOTH * (v + 1)))
    mix = MIX if n else 0.0

    def word_logs(seqs: list[np.ndarray]) -> np.ndarray:
        """The model's log probability of each word of the texts, their ends too."""
        classes, before = sequences(seqs)
        x, y, fine, _ = Attention.blocks(classes, before)
        each = model.log_probs(x, y, fine)[y >= 0]
        inner = np.ones(len(each), bool)
        inner[np.cumsum([len(c) for c in classes]) - 1] = False
        each[inner] += within_class(np.concatenate(seqs), np.concatenate(classes)[inner], np.concatenate(before)[inner])
        return np.add.reduceat(each, word_begins(seqs, size))

    def scored(batches):
        """Each flush's documents, from its table and the answers to it."""
        _release()
        for rows in _grouped(batches, 2):
            t = Table(*next(r[3:6] for r in rows if r[1] == TABLE), size)
            count = np.zeros(len(t.length), np.int64)
            for r in rows:
                if r[1] == ANSWER:
                    count[np.frombuffer(r[4], np.int32)] = np.frombuffer(r[3], np.int64)
            for some, seqs in t.pieces():
                c = count[t.word[t.begins[some[0]] : t.begins[some[-1] + 1]]]
                begins = t.begins[some] - t.begins[some[0]]
                logs = word_logs(seqs)
                if mix:
                    logs = np.logaddexp(logs + np.log1p(-mix), np.log(np.maximum(c / n * mix, 1e-300)))
                state = t.states[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(t.ids[some], mask=state == NO_ID),
                        pa.array(state == HELD, mask=state == NO_ID),
                        pa.array(t.sizes[some].astype(np.int64)),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)),
                        pa.array(np.add.reduceat(np.log10(c + SMOOTH), begins) - t.sizes[some] * scale),
                        pa.array(np.add.reduceat(logs, begins) / np.log(10)),
                        pa.array(np.array([len(x) for x in seqs], np.int64)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_symbols"],
                )

    flushes = rows.where(F.col("kind") == TABLE).unionByName(met.where(F.col("kind") == ANSWER)).repartition("flush").sortWithinPartitions("flush")
    done = flushes.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_symbols long")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_symbols")
