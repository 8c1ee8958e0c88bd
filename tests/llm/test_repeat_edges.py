"""Repeated strings on repeated rows, null ids, a very long text, ties and clashing column names."""

import random

from test_corpus_operators import plain_repeats

from kerbgrid.llm import repeats


def test_repeats_of_odd_rows(spark):
    rng = random.Random(8)
    line = "".join(rng.choices("abcdefgh ", k=230))
    texts = [line, line, "x" + line[:199], "y" + line[:200] + "é" * 100, "ab" * 20_000, "".join(rng.choices("abc", k=60_000)) + line + "end", "é" * 99, None, ""]
    ids = [4, 4, None, None, 7, 8, 9, 10, 10]
    rows = [(i, t, 1, "s", 2, b"d", 3, False) for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int, core string, n int, data binary, rank int, asked boolean")
    got = sorted((tuple(r) for r in repeats.repeats_report(docs).collect()), key=str)
    assert got == sorted([(i, *want) for i, want in zip(ids, plain_repeats(texts))], key=str)
    kept = {r["n_bytes"]: r["n_removed"] for r in repeats.repeats_report(docs).collect()}
    assert kept[230] == 230 and kept[200] == 0 and kept[401] == 200 and kept[40_000] == 40_000


def test_rounds_find_each_edge(spark):
    """Two texts share a run of each length around the threshold, at places of their own."""
    rng = random.Random(9)
    letters = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    texts = []
    for length in (199, 200, 201, 207, 263, 264, 400):
        run = letters(length)
        texts += [letters(rng.randint(0, 300)) + "1" + run + "2" + letters(rng.randint(0, 300)), letters(rng.randint(0, 300)) + "3" + run + "4"]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeats_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == list(plain_repeats(texts))
    assert [got[2 * k][1] for k in range(7)] == [0, 200, 201, 207, 263, 264, 400]
