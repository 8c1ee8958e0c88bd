"""Each occurrence of a segment has dropout draws of its own."""

import numpy as np

from kerbgrid.llm import pieces


def test_occurrences_are_cut_independently():
    words = pieces.vocabulary()
    text = "international " * 3000
    ids = pieces.Encoder(words, 0.1).encode([(7, text)])[0].tolist()
    assert pieces.decode(ids, words) == text
    coder = pieces.Encoder(words, 0.1)
    parts, salt = coder.segments(text), pieces.mixed(np.array([7], np.uint64) * pieces._C + np.uint64(coder.seed))[0]
    keys = pieces.mixed(np.arange(len(parts), dtype=np.uint64) * pieces._A + salt)
    cut = coder.cut(parts, keys)
    assert len(set(cut[1:3000])) > 20
    assert cut == [coder.cut_long(s, k) for s, k in zip(parts, keys)]
    whole = pieces.Encoder(words, 0.0).encode([(0, " international")])[0]
    assert 0.02 < np.mean([x == whole[-len(x) // 4 :].tobytes() for x in cut[1:3000]]) < 0.98


def test_a_full_memory_changes_nothing(monkeypatch):
    words = pieces.vocabulary()
    rows = [(k, f"some words {k} and others of {k * k} letters " * 3) for k in range(30)]
    one = [x.tolist() for x in pieces.Encoder(words, 0.2).encode(rows)]
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    coder = pieces.Encoder(words, 0.2)
    assert one == [coder.encode([x])[0].tolist() for x in rows]
