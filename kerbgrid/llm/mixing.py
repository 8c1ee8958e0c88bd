"""Mixing sources to target weights by Pareto order sampling of whole documents.

Targets: sources, by code point (null last), weigh WEIGHTS in turn and share the sum of all sizes; no target is
above MOST times its source's size, and what is cut off goes to the others by weight. That level is found
exactly in one running sum over sources by size for their weight: the first source that is not cut off
fixes the share of a weight.

Samples: a document of a source that is wanted r = target / size times comes floor(r) times for certain, and
once more with inclusion probability r - floor(r). Documents of a source are ranked by the odds of a random
number of their own, divided by the odds of that probability (Pareto order sampling); the first ones whose
sizes fit into the words that the certain copies leave are taken, so the sample has a fixed size in words. The
last place goes to the document, of those left, whose size comes nearest to the words still open, if any
brings the source nearer to its target. Chances differ by source, and within one where weight names a column of
positive numbers (to six decimals; null is 1): copies are expected in proportion to it, at most MOST of each
document, and what is cut off goes to the source's other documents.

Random numbers are hashes of seed, doc_id and text, so reruns and lost executors change nothing. Ranked
rows are dealt by ranges of source and rank, so a source of any size is spread.

Odd cases: null and empty texts have size 0 and are taken 0 words of; rows that repeat id and text are
ranked one by one with equal numbers, ids may be null or repeated; null is a source of its own; an empty
table has no rows. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import only
from kerbgrid.scratch import ahead, dropped, running, written

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of sources (source, source_size), one row each."""
    named, pieces = running(sources, [], [F.col("source").asc_nulls_last()], "named", 0, lambda c, places: np.zeros((len(places), 0), np.int64))
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ahead(named, pieces, 0).select("source", "source_size", turn.alias("weight"))
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"]:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    # Sources that are cut off come first in the order of size for weight.
    order = [F.col("_per"), F.col("source").asc_nulls_last()]
    filled, pieces = running(ranked.withColumn("_per", F.col("source_size") / F.col("weight")), [], order, "filled", 2, lambda c, places: np.stack([c["source_size"], c["weight"]], 1))
    rows = ahead(filled, pieces, 2)
    left = total["size"] - most * (F.col("s0") - F.col("source_size"))
    share = left.cast("double") / (total["weight"] - (F.col("s1") - F.col("weight")))
    level = rows.filter(share * F.col("weight") <= most * F.col("source_size")).agg(F.min_by(share, "place").alias("share")).first()["share"]
    cut = (F.col("source_size") * most).cast("double")
    return rows.select("source", "source_size", (F.least(cut, F.lit(level) * F.col("weight")) if level is not None else cut).alias("target"))


def random_share(seed: int, *keys: Column) -> Column:
    """A number between 0 and 1, both excluded, fixed by seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def expected(rows: DataFrame, most: int) -> DataFrame:
    """rows (source, size, weight, target) with times, the expected copies of each: at most most, else in proportion
    to weight, so that a source's sizes times copies are its target. As in targets(), documents that are cut off
    come first in the order of weight, and one running sum finds the level."""
    order = [F.col("weight").desc(), F.col("doc_id"), F.col("size"), F.col("_row")]
    sums, pieces = running(rows, ["source"], order, "weighed", 2, lambda c, places: np.stack([c["size"], c["size"] * c["weight"]], 1))
    sums = ahead(sums, pieces, 2)
    whole = sums.groupBy(F.col("source").alias("of")).agg(F.max("s1").alias("all_s1"))
    left = sums.join(whole, F.col("source").eqNullSafe(F.col("of")))
    level = F.try_divide(F.col("target") - most * (F.col("s0") - F.col("size")), F.col("all_s1") - F.col("s1") + F.col("size") * F.col("weight"))
    level = left.filter(level * F.col("weight") <= most).groupBy("of").agg(F.min_by(level, "place").alias("level"))
    times = F.least(F.lit(float(most)), F.coalesce("level", F.lit(float(most))) * F.col("weight"))
    return sums.join(level, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "source", "size", "u", "source_size", "target", times.alias("times"))


def mixed(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document."""
    docs = only(documents, doc_id="long", text="string", source="string", **({weight: "double"} if weight else {}))
    micro = [F.coalesce(F.round(F.col(f"`{weight}`") * 1e6), F.lit(1e6)).cast("long").alias("weight")] if weight else []
    docs = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), random_share(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("u"), *micro), "sizes")
    sources = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    totals = written(targets(sources, weights, most).withColumnRenamed("source", "of"), "targets")
    dropped(sources)
    rows = docs.join(totals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    if weight:
        rows = expected(rows.withColumn("_row", F.monotonically_increasing_id()), most)
    else:
        rows = rows.withColumn("times", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    rows = rows.withColumn("certain", F.floor("times")).withColumn("chance", F.col("times") - F.col("certain"))
    # Without a chance nothing is drawn: such rows come last.
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.col("chance") / (1 - F.col("chance")))
    rows = rows.withColumn("_rank", odds).select("doc_id", "source", "size", "source_size", "target", "certain", (F.col("size") * F.col("certain")).alias("sure"), (F.col("chance") > 0).alias("chance"), "_rank", F.monotonically_increasing_id().alias("_row"))
    ranked, pieces = running(rows, ["source"], [F.col("_rank").asc_nulls_last(), F.col("doc_id"), F.col("size"), F.col("_row")], "ranked", 1, lambda c, places: c["size"][:, None])
    ranked = ahead(ranked, pieces, 1)
    open_ = ranked.groupBy(F.col("source").alias("of")).agg((F.max("target") - F.sum("sure")).alias("open"))
    ranked = written(ranked.join(open_, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("drawn", F.col("chance") & (F.col("s0") <= F.col("open"))), "drawn")
    dropped(docs, totals)
    last = _last_places(ranked).select(F.col("source").alias("of"), F.col("place").alias("last"))
    rows = ranked.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    copies = F.col("certain") + (F.col("drawn") | F.coalesce(F.col("place") == F.col("last"), F.lit(False))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _last_places(ranked: DataFrame) -> DataFrame:
    """source, place of the document that comes nearest to the words still open, where any comes nearer than none."""
    open_ = ranked.groupBy(F.col("source").alias("of")).agg(F.max("open").alias("words"), F.coalesce(F.max(F.when(F.col("drawn"), F.col("s0"))), F.lit(0)).alias("so_far"))
    rest = ranked.filter(F.col("chance") & ~F.col("drawn") & (F.col("size") > 0)).select("source", "place", "size").join(open_, F.col("source").eqNullSafe(F.col("of")))
    gap = F.col("words") - F.col("so_far")
    rows = rest.withColumn("off", F.abs(F.col("size") - gap)).filter(F.col("off") < gap)
    return rows.groupBy("source").agg(F.min_by("place", F.struct("off", "place")).alias("place"))


def mix_report(documents: DataFrame) -> DataFrame:
    return mixed(documents).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
