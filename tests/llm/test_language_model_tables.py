"""A flush's table holds its documents whole."""

import numpy as np

from driftline.llm import common
from driftline.llm import language_model as lm


def test_squeezed_and_back():
    for x in ([], [0], [1, 70_000, 0, 2**31 - 1]):
        assert lm._spread(lm._squeezed(np.array(x, np.int32))).tolist() == x


def test_table_has_every_documents_symbols_and_words():
    texts = [b"", "É x\x0by \x85z Word word".encode(), b"a b " * 60_000, "日本 😀 end".encode(), b" end", b"a"]
    ids, held = [3, None, 1, 1, 9, 2], [False, None, True, False, False, False]
    symbols = lm.Symbols(common.tokenizer_path())
    some = lm._Gathered(7, symbols)
    for d, h, t in zip(ids, held, texts, strict=True):
        some.add(d, h, t)
    (rows,) = [b.to_pylist() for b in some.rows()]
    (table,) = [r for r in rows if r["kind"] == lm.TABLE]
    t = lm.Table(table["a"], table["b"], table["c"], symbols.size)
    assert t.states.tolist() == [lm.TRAINS, lm.NO_ID, lm.HELD, lm.TRAINS, lm.TRAINS, lm.TRAINS]
    assert t.sizes.tolist() == [len(x.split()) + 1 for x in texts]
    want = [symbols.encode([x])[0].tolist() for x in texts]
    for training in (False, True):
        got = [(int(d), s.tolist()) for docs, seqs in t.pieces(training) for d, s in zip(docs, seqs, strict=True)]
        assert got == [(d, want[d]) for d in range(6) if not training or t.states[d] == lm.TRAINS]
    trained = np.concatenate([want[d] for d in range(6) if t.states[d] == lm.TRAINS]).astype(int)
    assert t.symbol_counts(symbols.size).tolist() == np.bincount(trained, minlength=2 * symbols.size).tolist()
    entries = [r for r in rows if r["kind"] == lm.ENTRY]
    assert sorted(np.concatenate([np.frombuffer(r["c"], np.int32) for r in entries]).tolist()) == list(range(len(t.length)))
    assert sum(np.frombuffer(r["b"], np.int32).sum() for r in entries) == t.sizes[t.states == lm.TRAINS].sum()
