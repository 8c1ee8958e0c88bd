"""The classifier's training against a plain follow-the-regularised-leader, one coordinate at a time."""

import math
import random
import tracemalloc

import numpy as np

from kerbgrid.llm import langid

ROWS = [("the cat sat on the mat", "en"), ("der Hund lag auf dem Sofa", "de"), ("le chat est sur la table", "fr"), ("the dog ran to the house", "en"), ("die Katze schlief im Haus", "de"), ("la maison est sur la rue", "fr"), ("a house on the hill", "en"), ("", "de"), ("123", "en")]


def plain(rows):
    features = langid.Features(langid._letter_table())
    data = [(dict(zip(*(x.tolist() for x in features.counts(t)))), y) for t, y in rows]
    data = [(c, y) for c, y in data if c]
    labels = sorted({y for _, y in data})
    idf = {i: math.log((1 + len(data)) / (1 + sum(i in c for c, _ in data))) + 1 for c, _ in data for i in c}
    vectors = []
    for c, y in data:
        v = {i: (1 + math.log(n)) * idf[i] for i, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append(({i: x / norm for i, x in v.items()}, y))
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= langid.L1:
            return 0.0
        return -math.copysign(abs(z[k]) - langid.L1, z[k]) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for at, (v, y) in enumerate(vectors):
            if at % 5 == 0:
                continue
            e = [math.exp(sum(x * weight((i, k)) for i, x in v.items())) for k in labels]
            steps = {(i, k): x * (e[j] / sum(e) - (k == y)) for i, x in v.items() for j, k in enumerate(labels)}
            for k, g in steps.items():
                old, w = n.get(k, 0.0), weight(k)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w
                n[k] = old + g * g
    return labels, {k: weight(k) for k in z}


def test_fit_equals_a_plain_one():
    labels, want = plain(ROWS)
    model = langid.fit(ROWS)
    assert model.labels == labels == ["de", "en", "fr"]
    got = {(int(i), labels[k]): float(model.weights[i, k]) for i, k in zip(*np.nonzero(model.weights))}
    kept = {k: w for k, w in want.items() if abs(w) > 1e-6}
    assert len(kept) > 100 and len(kept) < len(want)
    assert all(math.isclose(got.get(k, 0.0), w, rel_tol=1e-4, abs_tol=1e-6) for k, w in want.items()) and set(got) <= set(want)


def test_counts_of_pieces_equal_those_of_the_whole(monkeypatch):
    features, rng = langid.Features(langid._letter_table()), random.Random(3)
    texts = ["", " ", "a", "  ", "\ud800", "ΟΔΟΣ ΟΔΟΣ", *("".join(rng.choice(" .,aB9éΣßİ漢\n😀") for _ in range(rng.randrange(1, 60))) for _ in range(300))]
    whole = [features.counts(t) for t in texts]
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for text, (at, n) in zip(texts, whole):
            got = features.counts(text)
            assert np.array_equal(got[0], at) and np.array_equal(got[1], n), (piece, text)


def test_memory_of_a_long_text_is_that_of_a_piece():
    features, text = langid.Features(langid._letter_table()), "some words of a long text " * 600_000  # 16 MB
    features.counts("warm")
    tracemalloc.start()
    at, n = features.counts(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.sum() > 3 * len(text) - 10 and peak < 64 << 20


def test_temperature_is_the_least_loss_and_is_bounded_without_errors():
    rng = np.random.default_rng(5)
    ys = rng.integers(0, 3, 200)
    for logits in (4.0 * (np.arange(3) == ys[:, None]), rng.normal(size=(200, 3)) + 2 * (np.arange(3) == ys[:, None])):
        size = np.bincount(ys)[ys][:, None]
        target = ((np.arange(3) == ys[:, None]) * size + 1) / (size + 3)
        loss = lambda t: -(target * np.log(langid.softmax(logits / t))).sum()  # noqa: B023, E731
        found = langid.calibrated(logits, ys)
        grid = np.exp(np.linspace(-6, 6, 4001))
        assert math.isclose(found, min(grid, key=loss), rel_tol=0.01) and 0.05 < found < 20
    sure = langid.calibrated(4.0 * (np.arange(3) == ys[:, None]), ys)
    assert langid.softmax(np.array([4.0, 0, 0]) / sure)[0] < 0.99
    assert langid.calibrated(np.zeros((5, 3)), ys[:5]) == langid.calibrated(np.empty((0, 3)), ys[:0]) == 1.0


def test_rows_of_one_id_are_sampled_by_their_texts(spark):
    words = {"en": ["the", "house", "and", "tree"], "de": ["der", "hund", "und", "baum"]}
    rng = random.Random(1)
    rows = [(7, " ".join(rng.choice(words[y]) for _ in range(8)), y) for y in ("en", "de") for _ in range(600)] + [(7, "the same", "en")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert docs.filter(langid.remainder() != 1).count() == len(rows)
    seen = []
    fit, langid.fit_counts = langid.fit_counts, lambda data: seen.append([y for *_, y in data]) or fit(data)
    try:
        langid.train(docs, per_lang=100)
    finally:
        langid.fit_counts = fit
    assert 50 < seen[0].count("en") < 160 and 50 < seen[0].count("de") < 160


def test_counts_reach_the_driver_in_six_bytes_a_number(spark):
    seen, fit = [], langid.fit_counts
    langid.fit_counts = lambda data: seen.extend(data) or fit(data)
    try:
        docs = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(ROWS * 4)], "doc_id long, text string, lang string")
        langid.train(docs)
    finally:
        langid.fit_counts = fit
    features, texts = langid.Features(langid._letter_table()), {}
    for t, y in ROWS:
        at, n = features.counts(t)
        texts.setdefault(y, set()).add((tuple(at.tolist()), tuple(n.astype(int).tolist())))
    assert len(seen) > 10 and any(len(at) for at, _, _ in seen)
    for at, n, y in seen:
        assert at.itemsize + n.itemsize <= 6 and (tuple(at.tolist()), tuple(n.tolist())) in texts[y]


def test_packed_counts_come_back_and_sort_as_arrays_do():
    rows = [([], []), ([1], [3]), ([1, 2], [1, 1]), ([1, 300], [2, 5]), ([2], [1]), ([255], [1]), ([256], [1 << 33]), ([32767], [(1 << 32) - 1])]
    packed = [langid.packed(np.array(at, np.int64), np.array(n, np.int64)) for at, n in rows]
    assert [at for at, _ in packed] == sorted(at for at, _ in packed)
    assert [tuple(x.tolist() for x in langid.unpacked(*p)) for p in packed] == rows
    assert langid.packed(np.empty(0, np.int64), np.empty(0)) == (b"", b"")
