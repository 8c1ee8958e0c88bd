"""Repeats, Jaccard join, decontamination, pieces and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from kerbgrid.llm import decontaminate, jaccard, pieces, repeats


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tid string, n int")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n ", "one", "one two", "one two three", "z" * 900]
    for _ in range(25):
        out.append(" ".join(word() for _ in range(rng.randint(20, 200))))
    base = out[-1]
    for k in range(70):  # near copies, more than are compared pair by pair
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        out.append(" ".join(w))
    for k in range(60):  # one passage in texts of their own
        out.append(" ".join([word() for _ in range(rng.randint(1, 60))] + [passage] + [word() for _ in range(rng.randint(1, 60))]))
    out += [base, base, passage[:190], "tiny tiny", passage + passage]
    return out


def plain_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + 200] for x in data for p in range(len(x) - 199))
    for x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - 199):
            if seen[x[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(f and (k == 0 or not gone[k - 1]) for k, f in enumerate(gone))
        yield len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, f in zip(x, gone) if not f)).hexdigest()


def test_repeats(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeats_report(docs_of(spark, texts)).collect()}
    for i, want in enumerate(plain_repeats(texts)):
        assert got[i] == want, i
    assert repeats.repeats_report(docs_of(spark, texts[:1])).collect()[0]["n_removed"] == 0
    assert repeats.repeats_report(docs_of(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1])
def test_repeats_by_the_other_ways(spark, texts, monkeypatch, limit):
    """Few or no keys broadcast, texts shuffled instead of anchors broadcast."""
    monkeypatch.setattr(repeats, "HOT", limit)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", -1)
    some = texts[:45] + texts[-30:]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeats_report(docs_of(spark, some)).collect()}
    assert [got[i] for i in range(len(some))] == list(plain_repeats(some))


def test_jaccard_components(spark, texts):
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_report(docs).collect()}
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    for i, a in enumerate(sets):
        assert got[i] == (len(a), find(i)), i
    kept = [r["doc_id"] for r in jaccard.deduplicated(docs).collect()]
    assert sorted(kept) == sorted({find(i) for i in range(len(sets))})
    assert jaccard.deduplicated(docs).columns == docs.columns
    assert jaccard.jaccard_report(docs.limit(0)).count() == 0


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "A train leaves Berlin at 9 and runs 120 km to Prague, how long does it take at 60 km an hour?"), (2, None), (3, "too short"), (4, "The quick brown fox jumps over the lazy dog near the quiet river bank today.")], "item_id long, text string")
    texts = {
        1: "Intro words. A train leaves Madrid at 7 and runs 350 km to Lisbon, how long does it take at 70 km an hour? More.",
        2: "Before. The quick brown fox jumps over the lazy dog near the quiet river bank today. After.",
        3: "The quick brown fox is another animal than the lazy dog near a river.",
        4: None,
        5: "",
        6: "x " * 5000,
    }
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, hash string")
    for limit in (decontaminate.BROADCAST_ROWS, -1):
        decontaminate.BROADCAST_ROWS, old = limit, decontaminate.BROADCAST_ROWS
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
        decontaminate.BROADCAST_ROWS = old
        assert {i for i, r in got.items() if r["contaminated"]} == {1, 2} and len(got) == 6
        assert got[1]["item_id"] == 1 and got[1]["reparameterised"] and got[2]["item_id"] == 4 and not got[2]["reparameterised"]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


ODD = ["", "  a", " ", "▁x ▁▁", "<s> <0x41> é\0\t\n 日本語テキスト 🎉", "a" * 3000, " " * 300, "ab" * 500 + " " + "éclair" * 200, "   x   y", "Hello world, the end.", "literal▁ x"]


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    words = pieces.vocabulary()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text, ids in zip(ODD, pieces.Encoder(words, 0.0).encode(list(enumerate(ODD)))):
        assert "▁" in text or ids.tolist() == library.encode(text)
        assert pieces.decode(ids.tolist(), words) == text


@pytest.mark.parametrize("rate", [0.1, 0.7, 1.0])
def test_dropout_is_lossless_and_varied(rate):
    words = pieces.vocabulary()
    rows = [(i, t) for t in ODD for i in range(6)]
    out = [x.tolist() for x in pieces.Encoder(words, rate).encode(rows)]
    assert all(pieces.decode(ids, words) == t for (_, t), ids in zip(rows, out))
    assert out == [x.tolist() for x in pieces.Encoder(words, rate).encode(rows)]
    assert rate == 1.0 or len({tuple(x) for (_, t), x in zip(rows, out) if t == "Hello world, the end."}) > 1


def test_heap_and_rounds_agree():
    coder = pieces.Encoder(pieces.vocabulary(), 0.3)
    parts = sorted({s for t in ODD for s in coder.segments(t) if s != pieces._LITERAL and len(s) < 400})
    assert coder.cut_many(parts, np.full(len(parts), coder.keys[1])) == [coder.cut_long(s, coder.keys[1]) for s in parts]


def test_piece_report(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "no id"), (1, "  a")]
    got = pieces.piece_report(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")).collect()
    assert len(got) == len(rows) and all(r["lossless"] for r in got)
    assert pieces.piece_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    two = pieces.decoded(pieces.encoded(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(r["text"] for r in two) == sorted(t or "" for _, t in rows)


def test_pipeline_stages(spark, texts, tmp_path):
    rng = random.Random(6)
    words = {"en": "the and ing th er wh".split(), "de": "der und sch ung ein ae".split()}
    prose = [" ".join("".join(rng.choices(words[x], k=2)) for _ in range(40)) for k in range(60) for x in [("en", "de")[k % 2]]]
    rows = [(i, t, ("en", "de")[i % 2], "s", len(t)) for i, t in enumerate(prose)]
    item = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    extra = [None, "12345 !!", prose[3], prose[4] + " password=abcdefgh12345678", "The end. " + item]
    rows += [(100 + k, t, "en", "s", len(t or "")) for k, t in enumerate(extra)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "stage")
        assert k == 4 or docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert set(range(60)) <= kept[0] and not kept[0] & {100, 101}
    assert 102 not in kept[1] and set(range(60)) <= kept[1]
    assert 104 not in kept[2] and kept[3] == kept[4] == kept[2]
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["lossless"] for r in rows.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
