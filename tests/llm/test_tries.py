"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kerbgrid.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    base = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    paths = {c: own.get(base(c), [])[: h(c)] + v[h(c) :] for c, v in own.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df):
    return sorted(map(tuple, tries.prefix_trie(df).collect()), key=str)


def test_trie_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert trie(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def odd_rows():
    draw = random.Random(11)
    words = ["", "a", "b", "ab", "é", "\U0001f600", "x" * 50_000]
    rows = [(draw.choice([None, -7, -5, -1, *range(40)]), draw.choice([None, 0, 1, 2, 3, 7, 9, 11]), draw.choice([None, "", "user", "u"]), draw.choice([None, *words])) for _ in range(400)]
    rows += rows[:30]  # repeated rows
    rows += [(100, i, "r", "same") for i in range(300)] + [(105, i, "r", "same") for i in range(310)] + [(104, i, "r", str(i)) for i in range(20)]  # long ones, one the prefix of the other
    return rows + [(200 + i, 0, "user", "first") for i in range(700)]  # one hot node, more ends than are put together at once


@pytest.mark.parametrize("parts", [4, 29])
def test_trie_of_odd_rows_over_many_partitions(spark, parts):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in ("depth", "f0", "place", "s0", "rep")})
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_has_no_nodes_and_turnless_conversations_end_at_the_root(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert trie(spark.createDataFrame([(c, 1, "a", "b")], SCHEMA)) == plain([(c, 1, "a", "b")])


def test_equal_fingerprints_of_unlike_turns_are_noticed(spark, monkeypatch):
    rows = [(c, t, "r", f"{c}{t}") for c in (8, 21, 33) for t in range(9)]
    df, whole = spark.createDataFrame(rows, SCHEMA), tries.turn_class
    weak = lambda role, text, seed: (F.length(text).cast("long"), F.length(text).cast("long"))
    monkeypatch.setattr(tries, "turn_class", lambda role, text, seed: weak(role, text, seed) if seed == 0 else whole(role, text, seed))
    assert trie(df) == plain(rows)
    monkeypatch.setattr(tries, "turn_class", weak)
    with pytest.raises(ValueError):
        tries.prefix_trie(df)
