"""The codec of op4 and op5 gives the ids of the tokenizers library and of op6's own method."""

import random

import numpy as np

from driftline.llm import bpe, common


def test_library_codec_gives_the_same_ids():
    from tokenizers import Tokenizer

    path, rnd = common.tokenizer_path(), random.Random(3)
    marks = ["", "'s", "'LL", ",", "###", "\x1c", "\x85", "é", "ß", "İ", "Σ", "日本", "😀", "­", "é", "7", "<|endoftext|>", "\x00", "\x7f"]
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rnd.randrange(1, 25))) + rnd.choice(marks) for _ in range(4000)]
    texts = ["", " \n", "x" * 20_000, *[" ".join(words[k : k + 20]) for k in range(0, 4000, 20)], *[" ".join(words[k : k + 20]) for k in range(0, 2000, 20)]]
    ids, begins = bpe.codec(path, bpe.LibraryCodec).encode_batch(texts)
    own, own_begins = bpe.codec(path).encode_batch(texts)
    assert np.array_equal(ids, own) and np.array_equal(begins, own_begins)
    tk = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == tk.encode(t, add_special_tokens=False).ids
