"""Decontamination against a plain version of its rules, and on repeated and null ids."""

import random
from collections import Counter

import regex

from kerbgrid.llm import decontaminate as d

ITEMS = [
    "{a} leaves {p} at {n} and runs {m} km to {q}, how long does it take?", "Say how many pears {a} and {b} hold when {a} buys {n} more.", "Compute {n} + {m}.", "Did {a} see {b}?",
    "Name the sum of {n}", "Add {n} and {m} and {n} and {m} and {n}", "the red house stands near {p} for {n} years. Which house is it", "{a} pays {n} dollars and {b} pays {m} dollars for one book",
]
VALUES = {"a": ["Ann", "Tom", "Zoe"], "b": ["Bob", "Eve", "Kim"], "p": ["Rome", "Oslo"], "q": ["Bonn", "Graz"], "n": ["3", "14", "7"], "m": ["120", "9", "35"]}


def words_of(text, starts=True):
    text = regex.sub(r"(^|[.!?\n])(\s*)(?=\p{Lu})", "\\1\\2\x04", text or "")
    words = [w for w in regex.split(r"(?:[^\p{L}\p{M}\p{N}\x04.,]|(?<![0-9])[.,]|[.,](?![0-9]))+", text) if w]
    plain_word = [w.replace("\x04", "") for w in words]
    number, tokens = [w[0].isdigit() or w.lower() in d.NUMBERS for w in plain_word], []
    for i, (w, p) in enumerate(zip(words, plain_word)):
        low = p.lower()
        name = w != low and p != p.upper() and not (w[0] == "\x04" and starts)
        tokens.append("#" if number[i] else "$" if low in d.UNITS and w == p and i and number[i - 1] else "@" if name and p != low else low)
    return plain_word, tokens


def literals(tokens):
    return sum(t not in ("#", "$", "@") for t in tokens)


def cut(words, tokens):
    return [(i, tuple(tokens[i : i + 5]), [w for w, t in zip(words[i : i + 5], tokens[i : i + 5]) if t in ("#", "$", "@")]) for i in range(len(tokens) - 4)]


def held_windows(documents, item):
    """(coverage, same) of the item's windows in the document's."""
    forms = [cut(*words_of(item, starts)) for starts in (True, False)]
    name, size = {one[0]: one[1] for one, two in zip(*forms) if literals(two[1]) >= 3}, len(words_of(item)[1])
    index = {(i, w, tuple(s), name[i]) for form in forms for i, w, s in form if i in name}
    theirs = {(i, w, tuple(t)) for form in documents for i, w, t in cut(*form)}
    rows = [(i - j, window, list(zip(s, t))) for i, w, t in theirs for j, x, s, window in index if w == x]
    scopes = {}
    for shift, window, pairs in rows:
        for scope in ((0,), (1, shift), (2, shift // size), (3, (shift + size // 2) // size)):
            scopes.setdefault(scope, []).append((window, pairs))
    best = (0.0, False)
    for group in scopes.values():
        votes = Counter(p for _, pairs in group for p in pairs)
        to = {x: max((n, b) for (a, b), n in votes.items() if a == x)[1] for x, _ in votes}
        kept = [(w, pairs) for w, pairs in group if all(to[a] == b for a, b in pairs)]
        if kept:
            best = max(best, (len({w for w, _ in kept}) / len(set(name.values())), all(a == b for _, pairs in kept for a, b in pairs)))
    same = [w for w, pairs in scopes.get((0,), []) if all(a == b for a, b in pairs)]
    return max(best, (len(set(same)) / len(set(name.values())), True)) if same else best


def held_whole(words, tokens, item):
    """None, or whether the document holds the item's own words, for items without a window."""
    theirs, typed = words_of(item)
    fold = lambda x: [w.lower().replace("\x04", "") for w in x]
    found = []
    for i in range(len(tokens) - len(typed) + 1):
        part = slice(i, i + len(typed))
        if fold(words[part]) == fold(theirs):
            found.append(True)
        if literals(typed) >= 3 and tokens[part] == typed:
            pairs = {(a, b) for a, b, t in zip(theirs, words[part], typed) if t in ("#", "$", "@")}
            if len(pairs) == len({a for a, _ in pairs}):
                found.append(all(a == b for a, b in pairs))
    return max(found, default=None)


def plain(text, items):
    words, tokens = words_of(text)
    out = {}
    for k, item in items.items():
        theirs, typed = words_of(item)
        if any(literals(w[1]) >= 3 for w in cut(*words_of(item, False))):
            coverage, same = held_windows([words_of(text, True), words_of(text, False)], item)
        elif typed:
            whole = held_whole(words, tokens, item)
            coverage, same = (0.0, False) if whole is None else (1.0, whole)
        else:
            continue
        if coverage >= d.SIMILARITY:
            out[k] = (-coverage, k, not same)
    best = min(out.values(), default=(0.0, None, False))
    return bool(out), best[1], sorted(out), best[2]


def filled(rng, item):
    return item.format(**{k: rng.choice(v) for k, v in VALUES.items()})


def test_equals_the_plain_version(spark, monkeypatch):
    rng = random.Random(1)
    items = {k: filled(rng, x) for k, x in enumerate(ITEMS)}
    docs = []
    for k in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice([items[rng.randrange(len(ITEMS))], filled(rng, rng.choice(ITEMS)), "Some words stand here", "and"])
            words = x.split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["", "and", "Ann", "9", "km"])
            parts.append(" ".join(words))
        docs.append((k, rng.choice([" ", ". ", ": ", "\n"]).join(parts)))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {k: plain(t, items) for k, t in docs}
    assert len({w[1] for w in want.values()}) > 5 and {w[3] for w in want.values()} == {False, True}
    for limit in (d.BROADCAST_ROWS, -1):
        monkeypatch.setattr(d, "BROADCAST_ROWS", limit)
        got = {r["doc_id"]: (r["contaminated"], r["item_id"], r["items"], r["reparameterised"]) for r in d.contamination(rows, bench).collect()}
        assert {k: (got[k], want[k], t) for k, t in docs if got[k] != want[k]} == {}


def test_repeated_and_null_ids(spark, monkeypatch):
    item, other = filled(random.Random(0), ITEMS[0]), filled(random.Random(3), ITEMS[0])
    words = item.split(" ")
    halves = (" ".join(words[:8]), " ".join(words[4:]))
    rows = [(1, item), (1, "clean"), (1, "Intro. " + item), (2, other), (2, other), (None, item), (None, "clean"), (None, None), (3, halves[0]), (3, halves[1]), (4, None), (4, "")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, document string, hash string")
    bench = spark.createDataFrame([(7, item), (7, item), (9, item), (None, None), (8, "")], "item_id long, text string")
    for limit in (d.BROADCAST_ROWS, -1):
        monkeypatch.setattr(d, "BROADCAST_ROWS", limit)
        got = sorted(((r["doc_id"], r["contaminated"], r["items"]) for r in d.contamination(docs, bench).collect()), key=str)
        assert got == sorted(((k, bool(t and (item in t or other in t)), [7] if t and (item in t or other in t) else []) for k, t in rows), key=str)
        kept = d.decontaminated(docs, bench)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((x for x in rows if not (x[1] and (item in x[1] or other in x[1]))), key=str)


def test_a_verbatim_item_after_a_colon(spark):
    bench = spark.createDataFrame([(1, "Name the largest red planet")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Here: Name the largest red planet"), (2, "Here: Find the largest red planet"), (3, "one may name the largest red planet")], "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in d.contamination(docs, bench).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, False)}
