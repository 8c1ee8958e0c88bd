"""Suffix-array dedup by distributed prefix doubling, on positions thinned without loss.

Removed is each byte covered by a THRESHOLD-byte string that also starts anywhere else, in the same
document or another. Sorting all positions' rank pairs would move many times the input, so positions
are thinned first: of the FIRST-byte strings in each THRESHOLD-byte window the one of least hash is the
window's anchor (leftmost of equals). Equal windows have their anchors at equal places, so a repeated
window's anchor has a repeated FIRST-byte string, and windows need only be compared below such anchors.

Doubling. The windows of an anchor are told apart by how many bytes they have before it. All of them hold
the anchor's FIRST bytes, whose fingerprint is its first rank; those between two such numbers hold a
longer string around the anchor, the longer the closer the numbers are. So ranks grow with the part of
the windows that they stand for: all, then parts of SIZES, down to one window of THRESHOLD bytes. In each
round a part's rank is the pair (rank so far, fingerprint of the bytes added before and after), pairs are
grouped and reranked, and parts whose pair is unique leave with all their windows. A part whose windows'
bytes together (its span) equal another's is repeated as a whole and done; one of equal spans stays, for
others to meet. The last round is past the threshold: its spans are the windows themselves.
Ranks are 64-bit fingerprints instead of dense numbers, which a distributed sort would have to hand out
in order; spans, which decide, have 128 bits. A text's identity is its 64-bit hash.

Equal whole texts are one text with a count; they are removed whole where they have THRESHOLD bytes.
Groups are only ever counted (smallest and largest occurrence differ) and joined back; the HOT most
frequent keys of a join are joined by broadcast where their rows lie, so no group meets in one task and no
task gets more than a HOT-th of the rows by one key. Null is empty, nothing is removed from
texts under THRESHOLD bytes, repeated rows are copies, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import dropped, map_rows, only, slices, written

THRESHOLD, FIRST = 200, 32
#: K-mers in a window.
WIDTH = THRESHOLD - FIRST + 1
_A = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
#: Low bits of a sort key that hold a position: texts are at most 1 GB.
_PLACE = 30
_WHOLE = 1 << 40
#: Windows of an anchor that stand together in each round.
SIZES = (64, 16, 4, 1)
#: Most frequent keys of a join that are broadcast.
HOT = 1000
#: Anchors (rows of fixed size, about 60 bytes) that go on after the first round, up to which they are
#: broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """anchors(data): places of the anchors, and the first and last window start of each."""

    def __init__(self) -> None:
        self.bytes = _mixed(np.arange(1, 257, dtype=np.uint64) * _A)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 17)
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
            self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) < THRESHOLD:
            return (np.empty(0, np.int64),) * 3
        self._grow(len(data) + 1)
        x = np.frombuffer(data, np.uint8)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes[x] * self.powers[: len(x)])])
        n = len(x) - FIRST + 1
        h = _mixed((sums[FIRST:] - sums[:n]) * self.inverses[:n])
        key = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
        span = 1
        while 2 * span <= WIDTH:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < WIDTH:
            key = np.minimum(key[: len(key) - (WIDTH - span)], key[WIDTH - span :])
        place = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        return place[first], first, last


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchor_rows(texts: DataFrame) -> DataFrame:
    """tid, at (first window start of the anchor), more (windows after it), off (of the anchor from at),
    fp (of the anchor's FIRST bytes), stretch (fingerprint of the bytes of all its windows)."""
    schema = "tid long, at long, more int, off int, fp long, stretch long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        find, h = Anchors(), xxhash.xxh3_64_intdigest
        for whole in batches:
            for part in slices(whole):
                places, counts, fp, stretch = [], [], [], []
                for text in part.column(1).to_pylist():
                    data = _utf8(text)
                    found = find(data)
                    places.append(np.stack(found))
                    counts.append(len(found[0]))
                    a, p, q = (x.tolist() for x in found)
                    fp += [h(data[x : x + FIRST]) for x in a]
                    stretch += [h(data[x : y + THRESHOLD]) for x, y in zip(p, q)]
                place, first, last = np.concatenate(places, axis=1)
                tid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array((place - first).astype(np.int32)), signed(fp), signed(stretch)], ["tid", "at", "more", "off", "fp", "stretch"])

    return texts.select("tid", "text").mapInArrow(run, schema)


def stretches(texts: DataFrame) -> DataFrame:
    """For texts (tid, text, anchors array<struct<at,more,off,fp,asked>>) each anchor as a part: tid, place,
    low and high (bytes of its windows before it), rank, asked, data (the windows' bytes)."""

    def rows(columns) -> Iterator[tuple]:
        for tid, text, anchors in zip(*columns):
            data = _utf8(text)
            for a in anchors:
                yield tid, a["at"] + a["off"], a["off"] - a["more"], a["off"], a["fp"], a["asked"], data[a["at"] : a["at"] + a["more"] + THRESHOLD]

    return map_rows(texts.select("tid", "text", "anchors"), "tid long, place long, low int, high int, rank long, asked boolean, data binary", lambda: rows)


def joined(rows: DataFrame, counts: DataFrame, *key: str) -> DataFrame:
    """rows with the columns of counts (a written table, one row for each key, n its rows), inner. rows is
    read twice: for the HOT keys of most rows, which are broadcast, and for the others."""
    hot = written(counts.orderBy(F.desc("n"), *key).limit(HOT), "hot")
    rest = rows.join(F.broadcast(hot.select(*key)), [*key], "left_anti").join(counts, [*key])
    return rows.join(F.broadcast(hot), [*key]).unionByName(rest).drop("n")


def settled(rows: DataFrame, *position: str) -> tuple[DataFrame, DataFrame]:
    """One round: rows (position, core, span1, span2, asked; core follows from the span) that asked and whose
    span stands at another position too; and those that go on, one of each span where another span has
    the same core and one that stands alone asks. Each with its other columns."""
    here = F.xxhash64(*position)
    spans = rows.groupBy("core", "span1", "span2").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.max("asked").alias("asks"), F.count("*").alias("n"))
    spans = written(spans.select("core", "span1", "span2", "first", (F.col("first") == F.col("last")).alias("alone"), "asks", "n"), "spans")
    cores = spans.groupBy("core").agg(F.count("*").alias("n"), F.max(F.col("alone") & F.col("asks")).alias("wanted"))
    cores = written(cores.filter("n > 1 and wanted").select("core", "n"), "cores")
    ranked = written(joined(rows, spans.drop("asks"), "core", "span1", "span2"), "ranked")
    done = ranked.filter("asked and not alone")
    going = joined(ranked.filter(here == F.col("first")).withColumn("asked", F.col("asked") & F.col("alone")), cores, "core")
    return done.drop("first", "alone"), going.drop("first", "alone", "span1", "span2")


def narrowed(parts: DataFrame, before: int, size: int) -> DataFrame:
    """Parts of at most `before` windows cut into parts of at most size: the columns of the part with its new
    bounds low2 and high2, core (the new rank) and the two fingerprints of its span."""
    top = WIDTH - 1
    cut = parts.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    old, new = F.floor(F.col("low") / before) * before, F.col("part") * size
    old_end, new_end = F.least(old + before - 1, F.lit(top)), F.least(new + size - 1, F.lit(top))
    cut = cut.select("*", F.greatest("low", new).cast("int").alias("low2"), F.least("high", new_end).cast("int").alias("high2"))
    bytes_at = lambda at, n: F.substring("data", (at + 1).cast("int"), n.cast("int"))
    begin, half = F.col("high") - F.col("high2"), F.lit(THRESHOLD // 2)
    added = F.xxhash64(bytes_at(F.col("high") - new, new - old), bytes_at(F.col("high") + THRESHOLD - old_end, old_end - new_end))
    bounds = ("low2", "high2")
    cut = cut.withColumn("core", F.xxhash64("part", "rank", added))
    return cut.select(
        "tid", "place", "low", "high", "asked", *bounds, "core",
        F.xxhash64(*bounds, "core", bytes_at(begin, half)).alias("span1"),
        F.xxhash64(*bounds, bytes_at(begin + half, F.col("high2") - F.col("low2") + THRESHOLD - half)).alias("span2"),
    )


def later_spans(parts: DataFrame) -> list[DataFrame]:
    """tid, start, end of the repeated windows of anchors that the first round leaves open (a written table
    of stretches()): a round for each of SIZES."""
    out, before = [], 2 * WIDTH
    for size in SIZES:
        done, going = settled(narrowed(parts, before, size), "tid", "place")
        out.append(done.select("tid", (F.col("place") - F.col("high2")).alias("start"), (F.col("place") - F.col("low2") + THRESHOLD).alias("end")))
        if size > 1:
            data = F.substring("data", (F.col("high") - F.col("high2") + 1).cast("int"), (F.col("high2") - F.col("low2") + THRESHOLD).cast("int"))
            whole = parts.drop("asked", "rank").join(going, ["tid", "place", "low", "high"])
            narrow = written(whole.select("tid", "place", F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("core").alias("rank"), "asked", data.alias("data")), "parts")
            dropped(parts)
            parts, before = narrow, size
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """tid (xxhash64 of the text) and spans array<struct<start,end>> in bytes, not merged, of all texts
    with repeats. A whole repeated text has the end _WHOLE."""
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    anchors = written(anchor_rows(texts), "anchors")
    here = F.xxhash64("tid", "at")
    twice = anchors.groupBy("fp").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count("*").alias("n")).filter("first <> last")
    # copies give equal rows, which are one place
    found = written(joined(anchors, written(twice.select("fp", "n"), "twice"), "fp").dropDuplicates(["tid", "at"]), "found")
    dropped(anchors)
    named = found.select("tid", "at", "more", "off", F.col("fp").alias("core"), F.col("stretch").alias("span1"), F.col("more").cast("long").alias("span2"), F.lit(True).alias("asked"))
    done, going = settled(named, "tid", "at")
    whole = done.select("tid", F.col("at").alias("start"), (F.col("at") + F.col("more") + THRESHOLD).alias("end"))
    anchor = F.struct("at", "more", "off", F.col("core").alias("fp"), "asked")
    going = written(going.groupBy("tid").agg(F.collect_list(anchor).alias("anchors")), "open")
    if going.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        going = F.broadcast(going)
    parts = written(stretches(texts.join(going, "tid")).dropDuplicates(["tid", "place"]), "parts")
    copies = texts.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").select("tid", F.lit(0).cast("long").alias("start"), F.lit(_WHOLE).alias("end"))
    for more in later_spans(parts):
        whole = whole.union(more)
    return whole.union(copies).groupBy("tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs within n bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b = min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs) and kept (the remaining bytes)."""
    docs = only(docs, doc_id="long", text="string")
    marks = repeated_spans(docs)
    rows = docs.withColumn("tid", F.xxhash64(F.coalesce("text", F.lit("")))).join(marks, "tid", "left").select("doc_id", "text", "spans")

    def cut(columns) -> Iterator[tuple]:
        for k, text, spans in zip(*columns):
            data = _utf8(text)
            runs = merged([(s["start"], s["end"]) for s in spans or ()], len(data)) if len(data) >= THRESHOLD else []
            held, at = [], 0
            for a, b in runs:
                held.append(data[at:a])
                at = b
            yield k, len(data), [{"start": a, "end": b} for a, b in runs], b"".join([*held, data[at:]])

    return map_rows(rows, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", lambda: cut)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = without_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

