"""Mixing against plain targets, a plain draw, and its own promises."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kerbgrid.llm import mixing, oracles

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    names = sorted(n for n in sizes if n is not None) + ([None] if None in sizes else [])
    weight, total = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, sum(sizes.values())
    free, out, left = set(names), {}, total
    while over := [n for n in free if left * weight[n] > 3 * sizes[n] * sum(weight[m] for m in free)]:
        for n in over:
            out[n] = 3.0 * sizes[n]
            free.discard(n)
        left = total - sum(3 * sizes[n] for n in out)
    return out | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}


def plain_mix(rows):
    """(doc_id, source, size, taken), each document in turn."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target, out = plain_targets(sizes), []
    for s in sizes:
        times = target[s] / sizes[s] if sizes[s] else 0.0
        certain, chance, ranked = int(times), times - int(times), []
        for i, t, _ in (r for r in rows if r[2] == s):
            key = f"0:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}"
            u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            ranked.append(((u / (1 - u)) / (chance / (1 - chance)) if chance else 0.0, (i is not None, i or 0), size(t), i))
        ranked.sort()
        open_, so_far, taken = target[s] - certain * sizes[s], 0, [certain * n for _, _, n, _ in ranked]
        at = 0
        while chance and at < len(ranked) and so_far + ranked[at][2] <= open_:
            so_far += ranked[at][2]
            taken[at] += ranked[at][2]
            at += 1
        gap = open_ - so_far
        rest = [(abs(n - gap), k) for k, (_, _, n, _) in enumerate(ranked) if k >= at and n and abs(n - gap) < gap]
        if chance and rest:
            taken[min(rest)[1]] += ranked[min(rest)[1]][2]
        out += [(i, s, n, t) for (_, _, n, i), t in zip(ranked, taken)]
    return target, sorted(out, key=str)


def odd_rows():
    draw = random.Random(13)
    text = lambda: draw.choice([None, "", " \t\n", "a b", *[" ".join("w" * draw.randrange(1, 4) for _ in range(draw.randrange(1, 90))) for _ in range(6)]])
    rows = [(draw.choice([None, *range(200)]), text(), draw.choice([None, "", "hot", "hot", "hot", "a", "b", "\U0001f600", "￿", "z"])) for _ in range(600)]
    return rows + rows[:40] + [(900, "word " * 100_000, "long"), (901, None, "nothing"), (902, "", "nothing")]


def test_mix_of_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("size", "target", "place", "u")})
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mixed(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    target, want = plain_mix(rows)
    assert sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got), key=str) == want
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and r["copies"] <= 3 for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_reruns_agree_and_sources_come_near_their_targets(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first = mixing.mixed(df)
    one = first.agg(F.sum(F.xxhash64(*first.columns) % 10**9)).first()[0]
    again = mixing.mixed(df.repartition(7))
    assert one == again.agg(F.sum(F.xxhash64(*again.columns) % 10**9)).first()[0]
    for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) < 0.002 * r["target"]


def test_weights_change_chances_but_not_targets(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randrange(1, 60), "ab"[i % 2], float(1 + 9 * (i % 10 == 0))) for i in range(4000)]
    got = mixing.mixed(spark.createDataFrame(rows, f"{SCHEMA}, quality double"), weight="quality").collect()
    weight = {r[0]: r[3] for r in rows}
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 0.01 * own[0]["target"] and all(r["copies"] <= 3 for r in own)
        # documents without a cut-off are expected in proportion to their weight
        light = [r["copies"] for r in own if weight[r["doc_id"]] == 1.0]
        total = sum(r["size"] * min(3.0, 10.0 * sum(light) / len(light) if weight[r["doc_id"]] > 1 else sum(light) / len(light)) for r in own)
        assert abs(total / own[0]["target"] - 1) < 0.1


def test_mix_equals_its_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{path}'")
    want = con.sql(oracles.ORACLES["op13_pareto_mix"]).limit(10**9).fetchall()
    assert sorted(map(tuple, mixing.mix_report(spark.read.parquet(path)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1}, {"a": 0, "b": 5}, {"a": 0}, {None: 4, "a": 1}, {c: (ord(c) * 7) % 31 for c in "abcdefghij"}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert {r["source"]: round(r["target"], 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
