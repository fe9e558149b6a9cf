import hashlib
import random
import struct

from driftline.llm import bpe, common

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def want(rows):
    t, out = library(), []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, bpe.roundtrip_digests(docs).collect()), key=str) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(spark):
    rnd = random.Random(0)
    texts = [None, "", " \n\t", "a\x1cb c\x85d e", "<|endoftext|>x <|startoftext|> <|endoftex", "ΑΣ ΣΑΣ İ ǅ ﬁ éa ́x", "it's we'll ''S 123 4½ 日本語 😀", "﻿abc", "zq" * 30_000, "a " * 20_000]
    texts += ["".join(chr(c) for c in range(a, a + 97) if not 0xD800 <= c < 0xE000) for a in range(1, 0x30000, 97 * 7)]
    texts += ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ,.'éß1", k=200)) for _ in range(100)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (3, "twice"), (3, "twice")]
    frame = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert sorted(map(tuple, bpe.roundtrip_digests(frame).collect()), key=str) == want(rows)
    assert bpe.roundtrip_digests(frame.where("false")).collect() == []


def test_backtracking_is_merging_by_rank():
    """The encoder against a plain merge loop."""
    c, rnd = bpe.codec(common.tokenizer_path()), random.Random(1)
    for _ in range(3000):
        word = "".join(rnd.choices("aehilnorstu", k=rnd.randrange(1, 14)))
        parts = [*word[:-1], chr(ord(word[-1]) + bpe.MARK)]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: c.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[k], parts[k + 1]) not in c.rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert c.encode_symbols(word[:-1] + chr(ord(word[-1]) + bpe.MARK)) == parts


def test_ids_and_back(spark):
    frame = spark.createDataFrame([(1, "Hello, World", "", ""), (2, None, "", "")], SCHEMA)
    e = bpe.encoded(frame)
    t = library()
    assert {r.doc_id: r.ids for r in e.collect()} == {1: t.encode("Hello, World", add_special_tokens=False).ids, 2: []}
    assert {r.doc_id: r.text for r in bpe.decoded(e).collect()}[1] == t.decode(t.encode("Hello, World", add_special_tokens=False).ids, skip_special_tokens=False)
