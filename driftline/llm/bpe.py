"""Byte-pair encoding in linear time by backtracking, and decoding by offset table.

A published word-level BPE vocabulary is loaded from a path, never trained. Every
vocabulary entry is a string over an alphabet of byte symbols, where the last symbol
of a word carries the end mark. The encoder

1. finds leftmost-longest vocabulary entries with an Aho-Corasick automaton,
2. accepts a token after its predecessor only if the *pair-compatibility table*
   says that merging their joined symbols gives exactly those two tokens,
3. otherwise backs up: a shorter entry at the same place, else one token back,
   never trying a (place) twice that is known to fail.

The merge result is the one sequence in which all neighbours are compatible, so
this equals applying the merges by rank, without a merge loop over the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftline.llm import common

#: Fixed values of the tokenizer file: its split pattern and special tokens.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_OF_WORD = "</w>"
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
WHITE = regex.compile(r"\p{White_Space}+")
#: A symbol that ends a word is shifted by this many code points.
MARK = 0x1000
#: From here on, characters' classes differ between Unicode versions; the tokenizer's own normalizers and splitter are asked.
STABLE = "\u0530"
UNSTABLE = re.compile("[\u0530-\U0010ffff]")
CACHE = 700_000


def byte_symbols() -> list[str]:
    """Byte-level BPE's printable stand-in of each byte: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        # decoding table: all tokens' bytes and where each begins
        size = max([*vocab.values(), *self.specials.values()]) + 1
        names = [""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            names[i] = t
        self.names = pa.array([n + " " for n in names], pa.large_string())
        self.split = pre_tokenizers.Split(Regex(SPLIT.pattern), "removed", invert=True)
        self.compose, self.lower = normalizers.NFC(), normalizers.Lowercase()
        self.word_cache: dict[str, tuple[int, ...]] = {}
        self._load_merges(path, spec["model"])
        self._reset()

    def _load_merges(self, path: str, model: dict) -> None:
        """What merging needs."""
        import ahocorasick

        self.rank: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self._marked(a), self._marked(b)] = k
        self.id_of = {self._marked(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        # an entry that no merge makes and that is no single symbol is never the result of merging
        self.id_of = {t: i for t, i in self.id_of.items() if len(t) == 1 or t in self.made}
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}
        self.shorter: dict[str, str] = {}
        self.widest = max(map(len, self.id_of))
        self.longest = ahocorasick.Automaton()
        for t in self.id_of:
            self.longest.add_word(t, t)
        self.longest.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}

    def _reset(self) -> None:
        self.chunk_cache: dict[str, int] = {}
        self.flat, self.offsets = array("I"), array("q", [0])

    @staticmethod
    def _marked(token: str) -> str:
        if token.endswith(END_OF_WORD) and token != END_OF_WORD:
            token = token[: -len(END_OF_WORD)]
            return token[:-1] + chr(ord(token[-1]) + MARK)
        return token

    def _ending(self, token: str) -> list[tuple[str, float]]:
        """The pieces that stand last while the token is being built, each with the merge that ends it."""
        if (found := self.ends.get(token)) is None:
            found, part, until = [], token, float("inf")
            while True:
                found.append((part, until))
                if (cut := self.made.get(part)) is None:
                    break
                part, until = cut[1], cut[2]
            self.ends[token] = found
        return found

    def _starting(self, token: str) -> list[tuple[str, float]]:
        """As _ending, for the pieces that stand first."""
        if (found := self.starts.get(token)) is None:
            found, part, until = [], token, float("inf")
            while True:
                found.append((part, until))
                if (cut := self.made.get(part)) is None:
                    break
                part, until = cut[0], cut[2]
            self.starts[token] = found
        return found

    def pair_ok(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border of two neighbours while both are built.

        A crossing merge wins if its rank is below that of the merge that takes the left
        piece away, and not above that of the right piece's (equal ranks go left first).
        """
        found = self.compatible.get((a, b))
        if found is None:
            rank, right = self.rank.get, self._starting(b)
            found = not any((k := rank((p, q))) is not None and k < p_until and k <= q_until for p, p_until in self._ending(a) for q, q_until in right)
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            self.compatible[a, b] = found
        return found

    def _shorter(self, token: str) -> str:
        """The next shorter entry that begins the token; empty if there is none."""
        found = ""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.id_of:
                found = token[:n]
                break
        self.shorter[token] = found
        return found

    def encode_symbols(self, word: str) -> list[str]:
        """Tokens of one marked word: leftmost-longest entries as long as they fit together, then backtracking."""
        if word in self.id_of:
            return [word]
        greedy = [t for _, t in self.longest.iter_long(word)]
        ok = self.compatible.get
        for k in range(1, len(greedy)):
            pair = (greedy[k - 1], greedy[k])
            fits = ok(pair)
            if fits is None:
                fits = self.pair_ok(*pair)
            if not fits:
                return self._backtrack(word, greedy, k)
        return greedy

    def _backtrack(self, word: str, greedy: list[str], k: int) -> list[str]:
        """Continues where greedy token k does not fit its predecessor."""
        tokens, token = greedy[:k], greedy[k]
        at, n = sum(map(len, tokens)), len(word)
        dead = bytearray(n + 1)
        ok, pair_ok, shorter, ids = self.compatible.get, self.pair_ok, self.shorter.get, self.id_of
        widest = self.widest
        while True:
            end = at + len(token)
            fits = False
            if not dead[end]:
                if tokens:
                    pair = (tokens[-1], token)
                    fits = ok(pair)
                    if fits is None:
                        fits = pair_ok(*pair)
                else:
                    fits = True
            if fits:
                tokens.append(token)
                if end == n:
                    return tokens
                at = end
                for stop in range(min(n, at + widest), at, -1):
                    if (token := word[at:stop]) in ids:
                        break
                continue
            less = shorter(token)
            if less is None:
                less = self._shorter(token)
            while not less:  # no entry is left here: one token back
                dead[at] = 1
                if not tokens:
                    raise ValueError(f"no encoding of {word!r}")
                token = tokens.pop()
                at -= len(token)
                less = shorter(token)
                if less is None:
                    less = self._shorter(token)
            token = less

    def _word(self, piece: str) -> tuple[int, ...]:
        found = self.word_cache.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                marked = piece
            else:
                s = self.symbols
                marked = "".join([s[b] for b in piece.encode()])
            marked = marked[:-1] + chr(ord(marked[-1]) + MARK)
            ids = self.id_of
            found = tuple([ids[t] for t in self.encode_symbols(marked)])
            if len(self.word_cache) >= CACHE // 2:
                self.word_cache.clear()
            self.word_cache[piece] = found
        return found

    def _chunk(self, chunk: str) -> int:
        """Number of a white-space-free chunk among the kept encodings."""
        number = self.chunk_cache[chunk] = len(self.offsets) - 1
        word = self._word
        if chunk.isalpha() and chunk.isascii():
            self.flat.extend(word(chunk))
        else:
            for piece in SPLIT.findall(chunk) if max(chunk) < STABLE else [p for p, _ in self.split.pre_tokenize_str(chunk)]:
                self.flat.extend(word(piece))
        self.offsets.append(len(self.flat))
        return number

    def _special(self, text: str) -> int:
        number = self.chunk_cache[text] = len(self.offsets) - 1
        self.flat.append(self.specials[text])
        self.offsets.append(len(self.flat))
        return number

    def _chunks(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif not UNSTABLE.search(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:
            text = self.lower.normalize_str(self.compose.normalize_str(text))
        # characters that str.split() takes for space but the tokenizer does not
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [c for c in WHITE.split(text) if c]
        return text.split()

    def _numbers(self, text: str) -> list[int]:
        if "<|" in text and SPECIAL.search(text):
            out: list[int] = []
            for part in SPECIAL.split(text):
                if part in self.specials:
                    number = self.chunk_cache.get(part)
                    out.append(self._special(part) if number is None else number)
                elif part:
                    out.extend(self._numbers(part))
            return out
        get, chunks = self.chunk_cache.get, self._chunks(text)
        numbers = list(map(get, chunks))
        if None in numbers:
            for k, number in enumerate(numbers):
                if number is None:
                    number = get(chunks[k])
                    numbers[k] = self._chunk(chunks[k]) if number is None else number
        return numbers

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text begins (one more place at the end)."""
        if len(self.chunk_cache) > CACHE:
            self._reset()
        numbers, begins = array("q"), [0]
        for text in texts:
            numbers.extend(self._numbers(text))
            begins.append(len(numbers))
        number = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        # views of the growing arrays, gone before they grow again
        offsets, flat = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        first = offsets[number]
        size = offsets[number + 1] - first
        ends = np.zeros(len(number) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        at = np.repeat(first - ends[:-1], size)
        at += np.arange(ends[-1])
        return flat[at], ends[np.array(begins)]

    def decode_batch(self, ids: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """Tokens' strings with a space between, from the offset table."""
        joined = self.names.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64)[joined.offset :]
        view = memoryview(data) if data is not None else memoryview(b"")
        places = ends[begins] if len(ids) else np.zeros(len(begins), np.int64)
        return [bytes(view[a : max(a, b - 1)]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]


class LibraryCodec(Codec):
    """A codec whose words are merged by the tokenizers library, for operators to which ids are only an input; the same ids in less time."""

    def _load_merges(self, path: str, model: dict) -> None:
        from tokenizers import Tokenizer

        self.merged = Tokenizer.from_file(path).model.tokenize

    def _word(self, piece: str) -> tuple[int, ...]:
        found = self.word_cache.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                marked = piece
            else:
                s = self.symbols
                marked = "".join([s[b] for b in piece.encode()])
            found = tuple([t.id for t in self.merged(marked)])  # the library marks the end itself
            if len(self.word_cache) >= CACHE // 2:
                self.word_cache.clear()
            self.word_cache[piece] = found
        return found


_codecs: dict[tuple, Codec] = {}


def codec(path: str, kind: type = Codec) -> Codec:
    """One codec for each process, path and kind; the vocabulary has a fixed size."""
    common.claim("codec", _codecs.clear)
    if (path, kind) not in _codecs:
        _codecs[path, kind] = kind(path)
    return _codecs[path, kind]


def strings_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.cast(pa.string()).to_pylist()]


def roundtrip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text, as digests.

    One row for each input row, in one narrow pass without shuffle. Null and empty
    texts have no ids and decode to the empty text; a null id stays null; repeated
    rows give repeated rows; other columns are ignored, whatever their names.
    Result: doc_id, n_tokens, ids_sha256, decoded_sha256.
    """
    path = path or common.tokenizer_path()

    def run(batches):
        c = codec(path)
        for b in common.pieces(batches, 256):
            ids, begins = c.encode_batch(strings_of(b.column(1)))
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else memoryview(b"")
            places = (begins * 4).tolist()
            digests = [hashlib.sha256(raw[a:e]).hexdigest() for a, e in zip(places, places[1:], strict=False)]
            decoded = [hashlib.sha256(t).hexdigest() for t in c.decode_batch(ids, begins)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(begins)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kept = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text: the operator's plain output."""
    path = path or common.tokenizer_path()

    def run(batches):
        c = codec(path)
        for b in common.pieces(batches, 256):
            ids, begins = c.encode_batch(strings_of(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids decode to null."""
    path = path or common.tokenizer_path()

    def run(batches):
        c = codec(path)
        for b in common.pieces(batches, 256):
            lists = [np.asarray(x if x is not None else [], np.uint32) for x in b.column(1).to_pylist()]
            begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = c.decode_batch(np.concatenate([*lists, np.zeros(0, np.uint32)]), begins)
            out = [None if null else t.decode() for t, null in zip(texts, b.column(1).is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
