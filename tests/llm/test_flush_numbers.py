"""A flush numbers its words in Arrow, as bytes.split() cuts them."""

import random

from driftline.llm import common
from driftline.llm import language_model as lm


def test_numbers_are_those_of_split_words():
    rnd = random.Random(4)
    parts = [b" ", b"  ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1f", b"\x00", b"A", b"b", b"Zz", "É".encode(), "\x85".encode(), " ".encode(), "日本".encode(), b"end"]
    texts = [b"", b" ", b"\n\n", *[b"".join(rnd.choices(parts, k=rnd.randrange(1, 30))) for _ in range(300)], b""]
    some = lm._Gathered(3, lm.Symbols(common.tokenizer_path()))
    for k, t in enumerate(texts):
        some.add(k, False, t)
    want = [[*t.lower().split(), b" end"] for t in texts]
    size, word, distinct = some._numbered()
    assert size.tolist() == [len(w) for w in want] and some.tokens >= size.sum()
    assert [distinct[k] for k in word.tolist()] == [w for ws in want for w in ws]
    assert distinct == list(dict.fromkeys([b" end", *[w for ws in want for w in ws]]))


def test_words_kept_at_once_have_the_symbols_of_each_alone():
    rnd = random.Random(6)
    words = list(dict.fromkeys("".join(rnd.choices("abcdefgh'strevml,.#7!|<>\x1c\x7fé", k=rnd.randrange(1, 12))) for _ in range(3000)))
    one, each = (lm.Symbols(common.tokenizer_path()) for _ in range(2))
    each.codec = type(each.codec)(common.tokenizer_path())
    got, begins = one.encode([" ".join(words).encode()])
    want = []
    for w in words:
        first = each.codec.offsets[each._word(w)]
        ids = list(each.codec.flat[first:])
        want += [*ids[:-1], ids[-1] + each.size]
    assert got.tolist() == want and begins.tolist() == [0, len(want)]
