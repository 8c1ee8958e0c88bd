"""The near-duplicate stage of the pipeline against brute force, at its own shingles and threshold."""

import random

import corpus_pipeline
from kerbgrid.llm import jaccard


def _set(text, width):
    w = text.encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def _similarity(a, b, width):
    x, y = _set(a, width), _set(b, width)
    return len(x & y) / len(x | y) if x and y else 0.0


def test_stage_drops_near_copies_between_the_thresholds(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = ["", "one", "one two three four", "one two three four"]
    for n in (8, 12, 30, 45, 46, 47, 60, 120, 300, 700):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for edits in sorted({1, max(1, n // 70), max(1, n // 50), max(1, n // 46), max(1, n // 40), n // 10 + 1}):
            copy = list(base)
            for k in range(edits):
                copy[(k * n) // edits + n // (2 * edits + 1)] = word()
            texts.append(" ".join(copy))
        texts += [" ".join(base[1:]), " ".join(base + [word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, between = list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            five = _similarity(a, texts[j], 5)
            if five >= 0.8:
                between += _similarity(a, texts[j], 3) < 0.9
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert between > 5
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted({find(i) for i in range(len(texts))})
    assert len(kept) < jaccard.deduplicated(docs).count()


def test_components_take_no_round_more_than_links_need(spark, monkeypatch):
    rng, writes = random.Random(5), []
    monkeypatch.setattr(jaccard, "written", lambda df, what, f=jaccard.written: writes.append(what) or f(df, what))
    chain = [(k, k + 1) for k in range(9)]
    odd = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    for links, most in (([], 1), ([(4, 4)], 1), ([(3, 1), (1, 2), (9, 8), (8, 9)], 2), (chain, 99), (odd, 99)):
        root = {x: x for e in links for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        writes.clear()
        got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root if find(x) != x} and len(writes) <= most
