"""N-gram Jaccard join with set-relation skipping.

Sets. A document's set is its distinct shingles of so many words (WORDS, if not given) as 64-bit
hashes (ASCII upper case lowered, words cut at ASCII white space; with fewer words the sequence is the
one shingle). Two documents link when 100 * intersection >= similarity * union (SIMILARITY, if not
given; under 100). All bounds below follow from the two; figures are those of 90. Null, empty and wordless
texts have empty sets and link with nothing. Documents with equal sets are one node: (size, hash of the
sorted set). Rows with a null id take part where a row with an id has the same set; else they link with nothing.

Sieve. Linked sets x, y differ in at most t = (100 - similarity) (|x| + |y|) / (100 + similarity) tokens. Tokens
fall into p ranges of hash values, p > t, so at least p - t ranges hold the same tokens in both (p is
one number for all sets of a size window; a set also enters the window of the smallest set that it can
link with). A set goes on only where that many of its ranges stand in another set too (ranges empty in it
count as such). No linked set is lost; sets without near copies leave here, before any list of single
tokens is made.

Index. Tokens of the sets that go on have one global order: by the number of those sets that hold them,
then by hash; tokens of one set only come first. A set's first n - ceil(similarity n) + 1 tokens go to the
index lists with its size and the position. Lists are cut into blocks by size class, and the position
says which blocks an entry has to look at: with i tokens before it, a set of n tokens can still link with sets
of up to (n - i) (100 + similarity) / similarity - n tokens; it is dealt to the blocks of just those sizes, so
deeper entries skip all blocks but those of smaller sets, in the join key, before pairs are made.

Answers. Within a list, first each set is compared with a leader only (the set with the fewest tokens
of its own, then by a seeded hash), in ROUNDS rounds. Sets that link with a leader have answers that
derive from its: they are one component already. In the last join entries of the leader's component
meet only entries of other components. No link between components is lost, while a group of m copies
costs about m comparisons, not m * m.

Components come from large-star and small-star steps on tables in the shared folder; each round
starts from the roots of the one before. Copies, hot tokens and large groups: counts are combined
before shuffles, joins are plain equi-joins that adaptive execution may split. Repeated rows are copies
of each other; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import dropped, map_rows, only, slices, written

WORDS, SIMILARITY = 3, 90
#: Sets that go on up to which their ids are broadcast; beyond, texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Rounds of comparisons with leaders; size classes of an index list in the span of sizes that can link.
ROUNDS, CLASSES = 2, 4
#: Ranges beyond those that linked sets can differ in, per cent of these: what ranges without tokens cost.
SPARE = 15
#: Sets whose copies a task leaves out.
SEEN = 200_000
#: Bytes of text that become arrays at once.
BYTES_AT_ONCE = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Shingler:
    """Sets of texts, many at once by array arithmetic."""

    def __init__(self, width: int = WORDS) -> None:
        self.width = width
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, BYTES_AT_ONCE + (1 << 18))
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and which text it is of."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self._grow(len(data) + 1)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.powers[: len(data)])])
        hashes = _mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * _B)
        offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
        return hashes, np.searchsorted(offsets, starts, "right") - 1

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sorted set of each text."""
        held, size = [], 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass").lower()
            if held and size + len(b) > BYTES_AT_ONCE:
                yield from self._sets(held)
                held, size = [], 0
            held.append(b)
            size += len(b)
        if held:
            yield from self._sets(held)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        h, of = self.words(texts)
        ends = np.cumsum(np.bincount(of, minlength=len(texts)))
        every = _shingles(h, self.width)
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            if b - a >= self.width:
                yield np.unique(every[a : b - self.width + 1])
            else:
                yield _shingles(h[a:b], b - a) if b > a else h[:0]


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width word hashes."""
    n = max(len(h) - width + 1, 0)
    x = _mixed(h[width - 1 :] * _C) if n else h[:0]
    for k in range(width - 2, 0, -1):
        x = _mixed(h[k : k + n] * _B + x)
    return _mixed(h[:n] * _A + x)


def least(similarity: int) -> int:
    """The smallest set that links with other sets than equal ones: one differing token is more than
    1 - similarity of the union of smaller ones."""
    return -(-similarity // (100 - similarity))


def signature(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), 11)).astype(np.int64))


def window_bounds(most: int = 1 << 40) -> np.ndarray:
    """The smallest size of each window; sizes grow by 8 / 5."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 8 // 5))
    return np.array(out, np.int64)


def most_apart(n, similarity: int):
    """Tokens in which a set of n tokens and a set at least as large differ at most if they link."""
    return (100 - similarity) * (n + 100 * n // similarity) // (100 + similarity)


class Sieve:
    """Hashes of the ranges of sets."""

    def __init__(self, similarity: int) -> None:
        self.similarity, self.bounds = similarity, window_bounds()
        self.apart = most_apart(self.bounds[1:] - 1, similarity)
        self.ranges = self.apart + 1 + self.apart * SPARE // 100

    def windows(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each set and window: the set's number, and how many of its ranges another set must share; and
        for each of its ranges with tokens: which of those rows it is of, and its hash."""
        n = np.array([len(s) for s in sets], np.int64)
        high = np.searchsorted(self.bounds, n, "right") - 1
        low = np.searchsorted(self.bounds, -(-self.similarity * n // 100), "right") - 1
        low[n < least(self.similarity)] = high[n < least(self.similarity)] + 1
        times = high - low + 1
        own = np.repeat(np.arange(len(sets)), times)
        window = np.repeat(low, times) + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        if not len(own):
            return own, window, window, window
        ranges = self.ranges[window].astype(np.uint64)
        size = n[own]
        entry = np.repeat(np.arange(len(own)), size)
        tokens = np.concatenate([sets[k] for k in own.tolist()])
        part = (tokens >> np.uint64(32)) * ranges[entry] >> np.uint64(32)  # ascending within a set
        starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (entry[1:] != entry[:-1])]))
        sums = np.add.reduceat(_mixed(tokens ^ _C), starts)
        row = entry[starts]
        hashes = _mixed(sums + part[starts] * _A + ranges[row] * _B)
        apart = np.minimum(most_apart(size, self.similarity), self.apart[window])
        return own, np.bincount(row, minlength=len(own)) - apart, row, hashes


def set_nodes(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n (size of the set), sig and needs (for each window of the set how many ranges it must
    share, none where it is too small to link with another one) of each row."""

    def make() -> Callable:
        shingler, sieve = Shingler(words), Sieve(similarity)

        def rows(columns) -> Iterator[tuple]:
            sets = list(shingler.sets(columns[1]))
            own, need, _, _ = sieve.windows(sets)
            needs: list[list[int]] = [[] for _ in sets]
            for k, x in zip(own.tolist(), need.tolist()):
                needs[k].append(x)
            return ((k, len(s), signature(s), x) for k, s, x in zip(columns[0], sets, needs))

        return rows

    return map_rows(only(docs, doc_id="long", text="string"), "doc_id long, n long, sig long, needs array<long>", make)


def range_rows(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """part (hash of a range), mark (the upper bits of the set's sig, and in the last bit which of its
    windows it is). Of copies that a task meets soon after each other only the first gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sieve, seen = Shingler(words), Sieve(similarity), set()
        for whole in batches:
            for part in slices(whole):
                sets = {}
                for s in shingler.sets(part.column(0).to_pylist()):
                    if (k := signature(s)) not in seen:
                        sets[k] = s
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(sets)
                own, _, row, hashes = sieve.windows(list(sets.values()))
                if len(own):
                    second = np.concatenate([[False], own[1:] == own[:-1]])
                    mark = np.array(list(sets), np.int64)[own] >> 1 << 1 | second
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(mark[row])], ["part", "mark"])

    return only(docs, text="string").mapInArrow(run, "part long, mark long")


def shared_ranges(rows: DataFrame) -> DataFrame:
    """mark, shared: how many of the ranges of range_rows() stand in another set too. One shuffle by
    range; a list, however long, streams by in order of its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None  # range and mark of the last row, and whether it was its list's first
        for batch in batches:
            part, mark = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(part):
                continue
            if last is not None:
                part, mark = np.concatenate([[last[0]], part]), np.concatenate([[last[1]], mark])
            fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (mark[1:] != mark[:-1])])
            begins = np.concatenate([[last is None or last[2]], part[1:] != part[:-1]])[fresh]
            part, mark = part[fresh], mark[fresh]
            new = np.ones(len(mark), bool)
            new[0] = last is None
            out = [mark[~begins & new], mark[:-1][begins[:-1] & ~begins[1:]]]
            last = (part[-1], mark[-1], bool(begins[-1]))
            marks, times = np.unique(np.concatenate(out), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(times)], ["mark", "shared"])

    ordered = rows.repartition("part").sortWithinPartitions("part", "mark")
    return ordered.mapInArrow(run, "mark long, shared long").groupBy("mark").agg(F.sum("shared").alias("shared"))


def sieved(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """n, sig and the smallest doc_id of the sets that share as many ranges as they need in one of their windows."""
    sets = nodes.filter(F.size("needs") > 0).groupBy("n", "sig").agg(F.min("doc_id").alias("doc_id"), F.first("needs").alias("needs"))
    rows = sets.select("n", "sig", "doc_id", F.posexplode("needs").alias("k", "need")).withColumn("mark", F.shiftleft(F.shiftright("sig", 1), 1).bitwiseOR(F.col("k").cast("long")))
    return rows.join(shared, "mark", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("need")).groupBy("n", "sig").agg(F.min("doc_id").alias("doc_id"))


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """n, sig and the whole set of each document."""

    def make() -> Callable:
        shingler = Shingler(words)
        return lambda columns: ((len(s), signature(s), s.view(np.int64)) for s in shingler.sets(columns[0]))

    return map_rows(only(docs, text="string"), "n long, sig long, tokens array<long>", make)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for links (a, b), by large-star and small-star."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "edges")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, state()
    while now[0] and now != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        dropped(old)
        before, now = now, state()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _need(nx: Column, ny: Column, similarity: int) -> Column:
    """Tokens that linked sets of these sizes have in common at least."""
    return F.ceil((nx + ny) * similarity / (100 + similarity) - F.lit(1e-9))


def _largest(n: Column, i: Column, similarity: int) -> Column:
    """The largest size of a set that can link with a set of n tokens of which the first i are not shared."""
    return F.floor((n - i) * (100 + similarity) / F.lit(similarity) - n + F.lit(1e-6))


def _possible(nx: Column, ny: Column, i: Column, j: Column, similarity: int) -> Column:
    """Whether sets of these sizes can link if their first common tokens are at these positions."""
    return (100 * F.least(nx, ny) >= similarity * F.greatest(nx, ny)) & (1 + F.least(nx - i - 1, ny - j - 1) >= _need(nx, ny, similarity))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b: sigs) with na, nb (sizes) and both (common tokens)."""
    one = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))


def linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    return compared(pairs, sets).filter(100 * F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def index_entries(sets: DataFrame, similarity: int) -> DataFrame:
    """token, s (sig), n, pos, own (tokens of that set alone): the index entries of sets (n, sig, tokens)."""
    tokens = sets.select("sig", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(counts, "token").groupBy("sig").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    own = F.col("n") - F.size("shared")
    prefix = F.col("n") - F.ceil(F.col("n") * similarity / F.lit(100) - F.lit(1e-9)) + 1
    first = shared.withColumn("own", own).filter(F.col("own") < prefix).select("sig", "n", "own", F.posexplode(F.slice("shared", F.lit(1), (prefix - F.col("own")).cast("int"))).alias("k", "t"))
    return first.select("t.token", F.col("sig").alias("s"), "n", (F.col("own") + F.col("k")).alias("pos"), "own")


def block_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """a, b: the pairs of different components that entries (with root, and lead: the root of the list's
    leader) leave, joined by token and size class: see the module's text."""
    step = float(np.log(100 / similarity) / CLASSES)

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / step).cast("int")

    small = rows.withColumn("most", F.least(_largest(F.col("n"), F.col("pos"), similarity), F.floor(100 * F.col("n") / F.lit(similarity)))).filter("most >= n")
    small = small.select("token", F.col("s").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("root").alias("ra"), (F.col("root") == F.col("lead")).alias("main"), F.explode(F.sequence(size_class(F.col("n")), size_class(F.col("most")))).alias("block"))
    large = rows.select("token", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("root").alias("rb"), (F.col("root") == F.col("lead")).alias("other_main"), size_class(F.col("n")).alias("block"))
    fits = (F.col("ra") != F.col("rb")) & (F.col("na") <= F.col("nb")) & _possible(F.col("na"), F.col("nb"), F.col("i"), F.col("j"), similarity)
    found = [x.join(y, ["token", "block"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for x, y in ((small.filter("not main"), large), (small.filter("main"), large.filter("not other_main")))]
    return found[0].union(found[1]).distinct()


def set_components(sets: DataFrame, similarity: int) -> DataFrame | None:
    """node, root (sigs) of all sets (n, sig, tokens) that link with another one."""
    entries, roots = written(index_entries(sets, similarity), "entries"), None
    for turn in range(ROUNDS + 1):
        rows = entries.withColumn("root", F.col("s")) if roots is None else entries.join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
        # lists of one component are done
        leads = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("own", F.xxhash64(F.lit(turn), "s").alias("h"), "s", "n", "pos", "root")).alias("lead")).filter("low <> high")
        rows = rows.join(leads.select("token", "lead"), "token")
        if turn < ROUNDS:
            fits = _possible(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos"), similarity)
            pairs = rows.filter("root <> lead.root").filter(fits).select(F.least("s", "lead.s").alias("a"), F.greatest("s", "lead.s").alias("b")).distinct()
        else:
            pairs = block_pairs(written(rows.withColumn("lead", F.col("lead.root")), "open"), similarity)
        links = linked(pairs, sets, similarity)
        if roots is not None:
            for end in ("a", "b"):
                links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        new = components(links)
        if roots is not None:
            moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            new = written(moved.union(new.join(roots, "node", "left_anti").select("node", "root")), "roots")
        roots = new
    return roots


def class_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of all rows, and (n, sig, component_id) of all sets."""
    docs = only(docs, doc_id="long", text="string")
    nodes = written(set_nodes(docs, words, similarity), "nodes")
    named = written(sieved(nodes, shared_ranges(range_rows(docs, words, similarity))), "named")
    ids = named.select("doc_id").distinct()
    if named.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sets = sets_of(docs.join(ids, "doc_id"), words).join(named.select("n", "sig"), ["n", "sig"], "left_semi")
    roots = set_components(written(sets.dropDuplicates(["n", "sig"]), "sets"), similarity)
    classes = nodes.filter("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("first"))
    found = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = found.groupBy("root").agg(F.min("first").alias("component_id"))
    return nodes, found.join(least, "root").select("n", "sig", "component_id")


def jaccard_report(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    nodes, classes = class_components(docs, words, similarity)
    return nodes.join(classes, ["n", "sig"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one document of each component: that with the smallest id. Of rows that share that
    id, all stay; documents without words and rows with a null id stay."""
    drop = jaccard_report(docs, words, similarity).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])
