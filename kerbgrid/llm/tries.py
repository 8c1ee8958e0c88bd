"""Prefix trie of rebuilt conversations by composable monoid fingerprints; no rebuilt text is ever made.

A turn's element is its place and its class, 120 bits of a hash of its role and text. A run of turns is the
product of its elements: for four bases a modulo a prime, the sum of class * a^(place - 1). Products
compose, so the prefix of a rebuilt conversation is the product of its base's head and of a slice of its own
turns, which is a difference of two running products moved to another place:
W(base head of k) + a^(k - h) * (W(own, j) - W(own, h)). Running products come from one pass over turns
dealt by ranges (scratch.running), so that a conversation of any length is spread. Prefixes of one depth and
product are one node. Equality is verified through references: each prefix row refers to its parent's product
and to the class of a stored turn; in a node all must agree (so, by depth, all earlier turns do), and the
stored turns of a class must have one role and text. If any does not, another seed is taken.

Sums over a subtree need no walk. Every node belongs to its smallest member; what a conversation owns is the
end of its path, from some depth on. Where Q is the bytes of its path before that depth, the saved tokens
below a node with P bytes before its last turn are the sum of Q - P over its members but the smallest, and
its leaves are the members that own a childless node: one sum a node, over its members.

Results in odd cases: rows without conv_id are left out; null roles and texts are empty; rows of one
conversation with equal turns are ordered by role and text; repeated rows are turns of their own; an empty
table has no rows, not even the root. Base c - c % 5 is as SQL has it (towards zero for negative ids).
Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import only
from kerbgrid.scratch import dropped, missing, running, written

#: The longest head that is taken from a base, and how many conversations share a base.
HEAD, SHARED = 8, 5
PRIME, LANES, SEEDS = (1 << 31) - 1, 4, 3
#: Ids of a node's ends that are put together in one row before they are hashed in order.
ENDS_AT_ONCE = 256
KEY = ("depth", "f0", "f1")


def bases(seed: int) -> list[int]:
    """Four bases by seed."""
    return [int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:12], 16) % (PRIME - 2) + 2 for i in range(LANES)]


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % (HEAD + 1)


def turn_class(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """Two longs of 60 bits each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return part(1), part(16)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo PRIME."""
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        left, square = left >> 1, square * square % PRIME
    return out


def _summands(seed: int):
    """Of each turn: its class at its place in four lanes, and its bytes."""
    of, low = bases(seed), (1 << 30) - 1

    def terms(columns: dict[str, np.ndarray], places: np.ndarray) -> np.ndarray:
        parts = [columns["c0"] >> 30, columns["c0"] & low, columns["c1"] >> 30, columns["c1"] & low]
        return np.stack([p * _powers(a, places) % PRIME for p, a in zip(parts, of)] + [columns["n_bytes"]], 1)

    return terms


def _join_pieces(seed: int):
    def joined(n: int, before: list[int], own: list[int]) -> list[int]:
        return [(b + pow(a, n, PRIME) * w) % PRIME for a, b, w in zip(bases(seed), before, own)] + [before[-1] + own[-1]]

    return joined


def _packed(lanes: list[Column]) -> tuple[Column, Column]:
    two = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return two(lanes[0], lanes[1]), two(lanes[2], lanes[3])


def _lanes(f: str, g: str) -> list[Column]:
    """The lanes of a packed product."""
    return [x for c in (F.col(f), F.col(g)) for x in (F.shiftright(c, 31), c.bitwiseAND(PRIME))]


def stored_turns(turns: DataFrame, seed: int) -> DataFrame:
    """conv, place (from 1), w0, w1 (running product, packed), c0, c1 (class), n_bytes, run (bytes so far)."""
    rows = turns.withColumns(dict(zip(("c0", "c1"), turn_class(F.col("role"), F.col("text"), seed))))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    # Texts go through the sort only where turns are tied.
    tied = written(turns.groupBy("conv", "turn").count().filter("count > 1").select(F.col("conv").alias("t_conv"), F.col("turn").alias("t_turn")), "tied")
    rows = rows.join(tied, (F.col("conv") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")), "left")
    rows = rows.select("conv", F.col("turn").alias("_turn"), F.when(F.col("t_conv").isNotNull(), F.col("role")).alias("_role"), F.when(F.col("t_conv").isNotNull(), F.col("text")).alias("_text"), "c0", "c1", "n_bytes")
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.monotonically_increasing_id()]
    table, pieces = running(rows, ["conv"], order, "turns", LANES + 1, _summands(seed), [PRIME] * LANES + [1 << 62], _join_pieces(seed))
    dropped(tied)
    sums = [(p, n, [*s, *[pow(a, n, PRIME) for a in bases(seed)]]) for p, n, s in pieces]
    rows = missing(table, sums, 2 * LANES + 1)
    power = [F.greatest(F.col(f"before_s{LANES + 1 + i}"), F.lit(1)) for i in range(LANES)]
    w0, w1 = _packed([(F.col(f"before_s{i}") + power[i] * F.col(f"s{i}")) % PRIME for i in range(LANES)])
    return rows.select("conv", (F.col("place") + F.col("before_place")).alias("place"), w0.alias("w0"), w1.alias("w1"), "c0", "c1", "n_bytes", (F.col(f"s{LANES}") + F.col(f"before_s{LANES}")).alias("run"))


def rebuilt(stored: DataFrame) -> DataFrame:
    """One row a conversation: conv, h, n (own turns), k (turns from the base), head (those turns), h0, h1, h_run
    (own product and bytes after h turns), b0, b1, b_run (the base's after k), length and total bytes."""
    head = F.struct("place", "w0", "w1", "c0", "c1", "n_bytes", "run")
    h, of_base = head_length(F.col("conv")), F.col("conv") % SHARED == 0
    at_h = lambda c: F.max(F.when(F.col("place") == h, F.col(c)))
    convs = stored.groupBy("conv").agg(F.max("place").alias("n"), F.max("run").alias("total"), at_h("w0").alias("h0"), at_h("w1").alias("h1"), at_h("run").alias("h_run"), F.array_sort(F.collect_list(F.when(of_base & (F.col("place") <= HEAD), head))).alias("first"))
    convs = written(convs, "convs")
    own = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % SHARED).drop("first")
    base = convs.filter(of_base).select(F.col("conv").alias("base"), "first")
    rows = own.join(base, "base", "left").withColumn("head", F.slice(F.coalesce("first", F.array().cast(convs.schema["first"].dataType)), F.lit(1), F.greatest("h", F.lit(1))))
    rows = rows.withColumn("head", F.when(F.col("h") > 0, F.col("head")).otherwise(F.slice("head", 1, 0))).withColumn("k", F.size("head"))
    last, zero, longer = F.try_element_at("head", F.lit(-1)), F.lit(0).cast("long"), F.col("n") > F.col("h")
    return rows.select(
        "conv", "h", "n", F.col("k").cast("long").alias("k"), "head", *[F.coalesce(c, zero).alias(c) for c in ("h0", "h1", "h_run")], F.coalesce(last["w0"], zero).alias("b0"), F.coalesce(last["w1"], zero).alias("b1"), F.coalesce(last["run"], zero).alias("b_run"),
        (F.col("k") + F.when(longer, F.col("n") - F.col("h")).otherwise(0)).alias("length"), (F.coalesce(last["run"], zero) + F.when(longer, F.col("total") - F.coalesce("h_run", zero)).otherwise(0)).alias("total"),
    )


def prefixes(stored: DataFrame, convs: DataFrame, seed: int) -> DataFrame:
    """One row for each conversation and depth: conv, depth, f0, f1 (product), p0, p1 (the parent's), c0, c1 (class
    of the last turn), n_bytes (of it), run (bytes so far), last (the conversation ends here)."""
    of, zero = bases(seed), F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("f0"), zero.alias("f1"), zero.alias("p0"), zero.alias("p1"), zero.alias("c0"), zero.alias("c1"), zero.alias("n_bytes"), zero.alias("run"), (F.col("length") == 0).alias("last"))
    one = convs.select("conv", "length", F.posexplode("head").alias("i", "e"), "head")
    before = lambda c: F.coalesce(F.get("head", F.col("i") - 1)[c], zero)
    heads = one.select("conv", F.col("e.place").alias("depth"), F.col("e.w0").alias("f0"), F.col("e.w1").alias("f1"), before("w0").alias("p0"), before("w1").alias("p1"), "e.c0", "e.c1", "e.n_bytes", "e.run", (F.col("e.place") == F.col("length")).alias("last"))
    lasting = convs.filter("n > h").drop("head")
    rows = stored.filter(F.col("place") > head_length(F.col("conv"))).join(lasting, "conv")
    back, low = F.col("h") - F.col("k"), (1 << 30) - 1
    shift = [F.element_at(F.array(*[F.lit(pow(a, -i, PRIME)).cast("long") for i in range(HEAD + 1)]), (back + 1).cast("int")) for a in of]
    moved = [(b + s * F.pmod(w - h, F.lit(PRIME))) % PRIME for b, s, w, h in zip(_lanes("b0", "b1"), shift, _lanes("w0", "w1"), _lanes("h0", "h1"))]
    depth = F.col("place") - back
    # The parent lacks the last summand, class * a^(depth - 1): that power is in the difference to the turn before.
    parts = [F.shiftright("c0", 30), F.col("c0").bitwiseAND(low), F.shiftright("c1", 30), F.col("c1").bitwiseAND(low)]
    rows = rows.select("*", depth.alias("depth"), *[m.alias(f"m{i}") for i, m in enumerate(moved)])
    less = [F.pmod(F.col(f"m{i}") - parts[i] * _power(a, F.col("depth") - 1) % PRIME, F.lit(PRIME)) for i, a in enumerate(of)]
    tails = rows.select("conv", "depth", *[c.alias(n) for n, c in zip(("f0", "f1", "p0", "p1"), (*_packed([F.col(f"m{i}") for i in range(LANES)]), *_packed(less)))], "c0", "c1", "n_bytes", (F.col("b_run") + F.col("run") - F.col("h_run")).alias("run"), (F.col("depth") == F.col("length")).alias("last"))
    return root.unionByName(heads).unionByName(tails)


def _power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo PRIME: the digits of the exponent look up powers in tables."""
    out = None
    for digit in range(7):  # 16 ** 7 turns
        table = F.array(*[F.lit(pow(base, v << (4 * digit), PRIME)).cast("long") for v in range(16)])
        one = F.element_at(table, (F.shiftright(exponent, 4 * digit).bitwiseAND(15) + 1).cast("int"))
        out = one if out is None else out * one % PRIME
    return out


def classes_agree(turns: DataFrame, stored: DataFrame, seed: int) -> bool:
    """Whether stored turns of one class have one role and text; only classes with several turns are looked at."""
    several = written(stored.groupBy("c0", "c1").count().filter("count > 1").select("c0", "c1"), "several")
    rows = turns.withColumns(dict(zip(("c0", "c1"), turn_class(F.col("role"), F.col("text"), seed)))).join(several, ["c0", "c1"], "left_semi")
    span = rows.groupBy("c0", "c1").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("role", "text") for f in (F.min, F.max)])
    agree = span.filter("role_min <> role_max OR text_min <> text_max").isEmpty()
    dropped(several)
    return agree


def ends(rows: DataFrame) -> DataFrame:
    """KEY, ends_sha256 over the ascending ids of the conversations that end at each node. Ids are sorted by ranges of
    node and id, put together ENDS_AT_ONCE at a time, and streamed through one hash a node: a hash takes its bytes
    in order, so a node's go through one task, but never into its memory."""
    names = [*KEY, "first", "ids"]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            keys = np.stack([c.to_numpy() for c in batch.columns[:3]], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            ids, cut = batch.columns[3].to_pylist(), []
            for a, b in zip(starts, starts[1:]):
                cut += [(*map(int, keys[a]), ids[i], ",".join(map(str, ids[i : min(i + ENDS_AT_ONCE, b)]))) for i in range(a, b, ENDS_AT_ONCE)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*cut)], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=[*KEY, "ends_sha256"])

    keys = "depth long, f0 long, f1 long"
    parts = rows.filter("last").select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(together, f"{keys}, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{keys}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    turns = only(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id IS NOT NULL")
    turns = turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(SEEDS):
        stored = written(stored_turns(turns, seed), "stored")
        convs = written(rebuilt(stored), "rebuilt")
        rows = written(prefixes(stored, convs, seed), "prefixes")
        same = [f(c).alias(f"{c}_{f.__name__}") for c in ("p0", "p1", "c0", "c1", "n_bytes", "run") for f in (F.min, F.max)]
        nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("rep"), F.count_if("last").alias("n_ends"), *same)
        nodes = written(nodes, "nodes")
        agree = nodes.filter(" OR ".join(f"{c}_min <> {c}_max" for c in ("p0", "p1", "c0", "c1", "n_bytes", "run"))).isEmpty()
        if agree and classes_agree(turns, stored, seed):
            break
        dropped(stored, convs, rows, nodes)
    else:
        raise ValueError(f"prefixes that differ had equal fingerprints for each of {SEEDS} seeds")
    dropped(stored)
    nodes = nodes.select(*KEY, "n_convs", "rep", "n_ends", F.col("p0_min").alias("p0"), F.col("p1_min").alias("p1"), (F.col("run_min") - F.col("n_bytes_min")).alias("before"))
    owned = nodes.groupBy(F.col("rep").alias("conv")).agg(F.min("before").alias("q"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    shares = convs.select("conv", "total").join(owned, "conv", "left").select("conv", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = rows.select("conv", *KEY).join(shares, "conv").groupBy(*KEY).agg(F.sum("q").alias("q_all"), F.min_by("q", "conv").alias("q_rep"), F.sum("leaf").alias("n_leaves"))
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("f0"), F.col("p1").alias("f1")).agg(F.count("*").alias("n_children"))
    # One group by node puts its parts together: no join meets in a hot key.
    parts = nodes.unionByName(members, allowMissingColumns=True).unionByName(kids, allowMissingColumns=True).unionByName(ends(rows), allowMissingColumns=True)
    whole = parts.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("n_convs", "rep", "p0", "p1", "before", "q_all", "q_rep", "n_leaves", "n_children", "ends_sha256")])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("rep").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(parents, ["depth", "p0", "p1"], "left").select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("q_all") - F.col("q_rep") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
