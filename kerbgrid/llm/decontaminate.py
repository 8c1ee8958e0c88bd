"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words of a text become typed tokens: numbers (in digits, 1,200 and 3.5 too, or words), names (capitalised
within a sentence) and units (after a number) become placeholders, other words are lower-cased. A capital that
starts a sentence may be a name or not: windows with one have two forms on both sides, and consistent
slots decide. Windows of WINDOW tokens with at least
LITERAL words that are no placeholders are hashed and joined with the windows of the benchmark. For
each document and item, the share of the item's distinct windows that the document holds is its
coverage. Slots are then compared: each value in an item's placeholders must always meet the same
value in the document's. As a document may hold an item several times with other values each, this is
judged in scopes, and the best one counts: the windows of one alignment (place in the document less
place in the item), those of alignments near each other (two overlapping grids of the item's length,
so that up to half of it may be put in or left out), all of the document's, and those with the item's
own values. Windows that contradict a scope's most frequent mapping don't count in it. A document is
contaminated where the coverage of an item is at least SIMILARITY; reparameterised where the slot
values of its best scope differ (among equals, the item's own values come first).

Items without a window (fewer than WINDOW tokens, or too few literal words in each) are one window as a
whole: their words must follow each other in the document, in either case of letters; where the whole
has LITERAL literal words, its typed tokens, with any consistent slot values, do too. In other items
windows with too few literal words are left out of the coverage.

Null and empty texts hold nothing. Repeated benchmark rows count once (smallest item_id). A document is
an id with a text: rows that repeat both are one, rows that repeat only the id (a null one too) are judged
each by its own text. The benchmark's windows are broadcast while at most BROADCAST_ROWS; beyond that the
hashes are shuffled with the slots of their windows. Long documents give rows for their windows, never one
large row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.llm.common import only, written

WINDOW, LITERAL, SIMILARITY = 5, 3, 0.8
#: Windows of the benchmark that are broadcast at most (about 100 MB).
BROADCAST_ROWS = 1_000_000
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
START = "\x04"
#: Units of measure and currency.
UNITS = "cent cents cm days dollars euros feet g grams hours inches kg kilograms kilometers km l lb litres liters m meters metres mg miles minutes ml mm months percent pounds seconds weeks yards years".split()


#: Numbers in words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
#: Words in lower case that may not be literal.
SPECIAL = [*NUMBERS, *UNITS]


def _split(text: Column) -> Column:
    """Words; a point or comma between digits is part of a number. One class tells most characters, of words, from separators."""
    plain = rf"a-zA-Z0-9{START}\p{{L}}\p{{M}}\p{{N}}"
    return F.array_remove(F.split(text, rf"[^{plain}](?:(?<![.,])|(?<![0-9].)|(?![0-9]))[^{plain}.,]*+"), "")


def marked(text: str) -> Column:
    """The text, behind a line break, with START before each capital that starts a sentence."""
    return F.regexp_replace(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"([.!?\n]\s*+)(?=\p{Lu})", f"$1{START}")


def _digit(w: Column) -> Column:
    return (w < ":") & (w >= "0")


def _number(low: Column) -> Column:
    return _digit(low) | low.isin([*NUMBERS, *[START + x for x in NUMBERS]])


def worded(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, words, low (in lower case) and their canonical tokens, one for each word. A capitalised word that starts a
    sentence has START before it, and is literal in tokens; see _token. Words are lowered one by one, but where a
    text has a capital sigma, whose lower form depends on what stands around it."""
    rows = rows.select(key, marked(text).alias("marked")).select(key, "marked", _split(F.col("marked")).alias("words"))
    low = F.when(F.col("marked").contains("\u03a3"), _split(F.lower("marked"))).otherwise(F.transform("words", F.lower))
    rows = rows.select(key, "words", low.alias("low"))

    def token(low: Column, i: Column) -> Column:
        w = F.get("words", i)
        return (
            F.when((low >= ":") & (w == low) & ~low.isin(SPECIAL), low)
            .when(_number(low), NUMBER)
            .when(low.isin(UNITS) & (i > 0) & _number(F.get("low", F.greatest(i - 1, F.lit(0)))), UNIT)
            .when(w == low, low)
            .when(low < "\x05", F.substring(low, 2, 1 << 30))
            .when(w != F.upper(w), NAME)
            .otherwise(low)
        )

    return rows.select(key, "words", "low", F.transform("low", token).alias("tokens"))


def _start(word: Column) -> Column:
    """Whether a word has START before it: all other characters of words are greater."""
    return word < "\x05"


def _token(i: Column, named: bool) -> Column:
    """The canonical token at i; named: with a name (or a literal word, where all letters are capitals) where a
    capitalised word starts a sentence."""
    t, w = F.get("tokens", i), F.get("words", i)
    return F.when(_start(w) & (t > UNIT) & (w != F.upper(w)), F.lit(NAME)).otherwise(t) if named else t


def windows(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, words, tokens) as one row for each window, and a second one, with form 1, for each window
    that holds the start of a sentence, where that is named: key, words, tokens, at, form, hash.
    The hashes are projected before they are exploded, so that the explosion and a broadcast join behind it are
    generated code, which hands the arrays on by reference and copies none for windows it drops.
    The outer form (a null hash for texts without windows, which no join keeps) spares the filter on
    the array's size that the optimizer would push down to the text, computing all of it twice."""
    none, last = F.array().cast("array<int>"), F.size("tokens") - WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
    every = F.when(last >= 0, F.sequence(F.lit(0), F.size("tokens") - 1)).otherwise(none)
    starts = F.filter(every, lambda i: _start(F.get("words", i)))

    def around(s: Column, j: Column) -> Column:
        """The windows whose last start of a sentence is s."""
        low, high = F.greatest(s - WINDOW + 1, F.lit(0)), F.least(s, F.coalesce(F.get("starts", j + 1) - WINDOW, s), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    hashes = lambda at, named: F.transform(at, lambda i: F.xxhash64(*[_token(i + k, named) for k in range(WINDOW)]))
    rows = rows.select(key, "words", "tokens", starts.alias("starts"))
    rows = rows.select(key, "words", "tokens", F.flatten(F.transform("starts", around)).alias("again"))
    rows = rows.select(key, "words", "tokens", "again", F.concat(hashes(at, False), hashes(F.col("again"), True)).alias("hashes"), F.greatest(last + 1, F.lit(0)).alias("n_at"))
    rows = rows.select(key, "words", "tokens", "again", "n_at", F.posexplode_outer("hashes").alias("i", "hash"))
    second = F.col("i") >= F.col("n_at")
    return rows.select(key, "words", "tokens", F.when(second, F.get("again", F.col("i") - F.col("n_at"))).otherwise(F.col("i")).alias("at"), second.cast("int").alias("form"), "hash")


def _slots() -> Column:
    """The words in the placeholders of a row of windows(), in its form."""
    word = lambda i: F.translate(F.get("words", i), START, "")
    typed = lambda i: F.when(F.col("form") == 1, _token(i, True)).otherwise(_token(i, False)) <= UNIT
    return F.concat(*[F.when(typed(F.col("at") + k), F.array(word(F.col("at") + k))).otherwise(F.array().cast("array<string>")) for k in range(WINDOW)])


def _literals(at: Column, form: Column) -> Column:
    one = lambda i: F.when(F.when(form == 1, _token(i, True)).otherwise(_token(i, False)) > UNIT, 1).otherwise(0)
    return sum((one(at + k) for k in range(WINDOW)), F.lit(0))


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words, low and tokens of each distinct text."""
    rows = only(benchmark, item_id="long", text="string").groupBy("text").agg(F.min("item_id").alias("item_id"))
    return worded(rows, "item_id")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, n (the item's distinct windows), at, window (its hash with literal starts of sentences), length (of
    the item), item_slots: a row for each form of a window. Windows with too few literal words in one of
    their forms are left out."""
    forms = windows(benchmark_words(benchmark), "item_id")
    literals = _literals(F.col("at"), F.col("form"))
    rows = forms.select("item_id", "at", "form", "hash", F.size("tokens").alias("length"), _slots().alias("item_slots"), literals.alias("literals")).filter("hash IS NOT NULL")
    whole = rows.groupBy("item_id", "at").agg(F.min("literals").alias("least"), F.max(F.when(F.col("form") == 0, F.col("hash"))).alias("window")).filter(F.col("least") >= LITERAL).drop("least")
    out = rows.drop("form", "literals").join(whole, ["item_id", "at"]).distinct()
    return out.join(whole.groupBy("item_id").agg(F.countDistinct("window").alias("n")), "item_id")


def document(docs: DataFrame) -> Column:
    """What names a document of docs: its id and a hash of its text."""
    return F.struct(docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("body"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document() and item that share a window: coverage, with consistent slots, and
    whether slot values differ."""
    index, key = written(benchmark_windows(benchmark), "index"), "document"
    rows = worded(docs.select(document(docs).alias(key), docs["text"].cast("string").alias("text")), key)
    found, theirs = windows(rows, key), index.withColumnRenamed("at", "at_item")
    slots = _slots()
    if index.count() <= BROADCAST_ROWS:
        found = found.join(F.broadcast(theirs), "hash")
    else:
        found, slots = found.select(key, "at", "hash", slots.alias("doc_slots")).join(theirs, "hash"), F.col("doc_slots")
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), slots.alias("doc"))
    shift = F.col("at") - F.col("at_item")
    found = written(found.select(key, "item_id", F.col("window").alias("hash"), "n", "length", shift.alias("shift"), pairs.alias("pairs")), "leaks")
    half = F.floor(F.col("length") / 2)
    places = [(0, F.lit(0)), (1, F.col("shift")), (2, F.floor(F.col("shift") / F.col("length"))), (3, F.floor((F.col("shift") + half) / F.col("length")))]
    scopes = F.array(*[F.struct(F.lit(k).alias("scope"), place.cast("long").alias("place")) for k, place in places])
    found = found.select(key, "item_id", "hash", "n", "pairs", F.explode(scopes).alias("s")).select(key, "item_id", "hash", "n", "pairs", "s.scope", "s.place")
    scope = [key, "item_id", "scope", "place"]
    # one mapping for each document, item and scope: the most frequent document value of each item value
    votes = found.select(*scope, F.explode("pairs").alias("p")).groupBy(*scope, F.col("p.item").alias("of"), F.col("p.doc").alias("to")).agg(F.count("*").alias("votes"))
    mapping = votes.groupBy(*scope, "of").agg(F.max(F.struct("votes", "to"))["to"].alias("to")).groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct("of", "to"))).alias("mapping"))
    same = found.filter("scope = 0").filter(F.forall("pairs", lambda p: p["item"] == p["doc"])).withColumn("scope", F.lit(4))
    found = found.join(mapping, scope, "left")
    found = found.filter(F.coalesce(F.forall("pairs", lambda p: F.element_at("mapping", p["item"]) == p["doc"]), F.lit(True)))
    by_scope = found.drop("mapping").unionByName(same).groupBy(*scope).agg(F.countDistinct("hash").alias("held"), F.max("n").alias("n"), F.max(F.exists("pairs", lambda p: p["item"] != p["doc"])).alias("differs"))
    best = by_scope.groupBy(key, "item_id").agg(F.max(F.struct((F.col("held") / F.col("n")).alias("coverage"), (~F.col("differs")).alias("same"))).alias("best"))
    out = best.select(key, "item_id", "best.coverage", (~F.col("best.same")).alias("reparameterised"))
    whole = whole_matches(rows, benchmark, index, key)
    return out if whole is None else out.unionByName(whole)


def _plain(words: str) -> Column:
    return F.transform(words, lambda w: F.translate(w, START, ""))


def _folded() -> Column:
    return F.transform("low", lambda w: F.translate(w, START, ""))


def whole_items(benchmark: DataFrame, index: DataFrame) -> DataFrame:
    """The items without a window: item_id, item_words, typed, sequence (typed tokens, or words in lower
    case), at, width and hash of the part by which it is looked up (the one richest in literals)."""
    usable = index.select("item_id").distinct()
    size = F.size("tokens")
    width = F.least(size, F.lit(WINDOW))
    at = -F.array_max(F.transform(F.sequence(F.lit(0), size - width), lambda i: F.named_struct(F.lit("literals"), _literals(i, F.lit(0)), F.lit("at"), -i)))["at"]
    forms = F.when(F.size(F.filter("tokens", lambda t: t > UNIT)) >= LITERAL, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = benchmark_words(benchmark).filter((size > 0) & F.col("item_id").isNotNull()).join(usable, "item_id", "left_anti")
    rows = rows.select("item_id", "words", "low", "tokens", at.alias("at"), width.alias("width"), F.explode(forms).alias("typed"))
    rows = rows.select("item_id", _plain("words").alias("item_words"), "typed", F.when(F.col("typed"), F.col("tokens")).otherwise(_folded()).alias("sequence"), "at", "width")
    return rows.withColumn("hash", F.xxhash64("typed", F.slice("sequence", F.col("at") + 1, F.col("width"))))


def whole_matches(rows: DataFrame, benchmark: DataFrame, index: DataFrame, key: str) -> DataFrame | None:
    """As matches(), for the items without a window; None where there are none."""
    items = written(whole_items(benchmark, index), "whole")
    forms = [(r["typed"], r["width"]) for r in items.select("typed", "width").distinct().collect()]
    if not forms:
        return None
    rows = rows.withColumn("low", _folded()).withColumn("words", _plain("words"))

    def places(typed: bool, width: int) -> Column:
        size, of = F.size("tokens"), "tokens" if typed else "low"
        at = F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.named_struct(F.lit("at_doc"), i, F.lit("hash"), F.xxhash64(F.lit(typed), F.slice(of, i + 1, F.lit(width)))))

    found = rows.withColumn("w", F.explode(F.concat(*[places(*x) for x in sorted(forms)]))).select(key, "words", "tokens", "low", "w.at_doc", "w.hash")
    if items.count() <= BROADCAST_ROWS:
        found = found.join(F.broadcast(items), "hash")
    else:
        found = found.select(key, "at_doc", "hash").join(items, "hash").dropDuplicates([key, "item_id", "typed", "at_doc"]).join(rows.dropDuplicates([key]), key)
    start = F.col("at_doc") - F.col("at")
    part = lambda of: F.slice(of, F.greatest(start, F.lit(0)) + 1, F.size("sequence"))
    found = found.filter((start >= 0) & (part(F.when(F.col("typed"), F.col("tokens")).otherwise(F.col("low"))) == F.col("sequence")))
    found = found.select(key, "item_id", "typed", F.arrays_zip(F.col("item_words").alias("item"), part(F.col("words")).alias("doc"), F.col("sequence").alias("token")).alias("pairs"))
    slots = F.array_distinct(F.transform(F.filter("pairs", lambda p: p["token"] <= UNIT), lambda p: F.named_struct(F.lit("item"), p["item"], F.lit("doc"), p["doc"])))
    found = found.select(key, "item_id", F.when(F.col("typed"), slots).alias("slots"))
    found = found.filter(F.col("slots").isNull() | (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["item"])))))
    differs = F.coalesce(F.exists("slots", lambda p: p["item"] != p["doc"]), F.lit(False))
    return found.groupBy(key, "item_id").agg(F.lit(1.0).alias("coverage"), F.min(differs).alias("reparameterised"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row of docs: doc_id, contaminated, item_id and coverage of its best item (smallest id
    among equals), items (all that it holds, sorted), reparameterised."""
    held = matches(docs, benchmark).filter(F.col("coverage") >= SIMILARITY)
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "item_id", "reparameterised"))
    by_doc = held.groupBy("document").agg(best.alias("best"), F.sort_array(F.collect_set("item_id")).alias("items"))
    rows = docs.select(document(docs).alias("document"))
    return rows.join(by_doc, "document", "left").select(
        F.col("document.id").alias("doc_id"),
        F.col("best").isNotNull().alias("contaminated"),
        F.col("best.item_id").alias("item_id"),
        F.coalesce(-F.col("best.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce(F.col("best.reparameterised"), F.lit(False)).alias("reparameterised"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones, all columns as they are."""
    bad = matches(docs, benchmark).filter(F.col("coverage") >= SIMILARITY).select("document").distinct()
    return docs.join(bad, document(docs) == bad["document"], "left_anti")
