"""Word problems with other names, numbers and units, names at the starts of sentences too."""

import random

from pyspark.sql import functions as F

from kerbgrid.llm import decontaminate

FORMS = [
    "{a} has {n} red apples in a basket. {a} gives {m} of them to a friend and then buys {k} more. How many apples does {a} have now?",
    "{a} walks {n} {u} to school each day. {b} walks only {m} {u} along the river. How much further does {a} walk than {b} in a week?",
    "A train leaves the station at {n} in the morning. {a} boards it with {b} and {m} heavy bags. When does the train arrive after {k} hours of travel?",
    "{a} bakes {n} small cakes. {b} eats {m} cakes before the party starts. {a} then bakes {k} more cakes for the guests. How many cakes are left for the guests?",
    "{b} saves {n} dollars every month. After {m} months the bank adds {k} dollars to the account. {b} spends half of it on a new bicycle. How much money does {b} keep?",
]
NAMES = "Tom Bob Ann Eve Zoe Kim Max Ida Lea Jon Mia Ben".split()
NUMBERS = ["3", "7", "12", "15", "40", "1,200", "3.5", "seven", "eight", "twenty"]
UNITS = ["km", "miles", "meters"]


def problem(rng, form):
    a, b = rng.sample(NAMES, 2)
    n, m, k = rng.sample(NUMBERS, 3)
    return form.format(a=a, b=b, n=n, m=m, k=k, u=rng.choice(UNITS))


def test_recall_of_reparameterised_problems(spark):
    rng = random.Random(10)
    items = [(i, problem(rng, f)) for i, f in enumerate(FORMS)]
    copies = [(i, problem(rng, FORMS[i % len(FORMS)])) for i in range(200)]
    words = " ".join(FORMS).replace("{", "").replace("}", "").split()
    clean = [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame([(i, f"Some text before. {t} And some after it.") for i, t in copies] + clean, "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    caught = got.filter("contaminated").select("doc_id", "item_id").collect()
    right = sum(r["doc_id"] < 200 and r["item_id"] == r["doc_id"] % len(FORMS) for r in caught)
    assert right >= 0.95 * 200 and all(r["doc_id"] < 200 for r in caught)


def test_capitalised_words_and_numbers_of_the_benchmark_swapped(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng, docs = random.Random(1), []
    for r in bench.collect():
        names, numbers = {}, {}
        out = []
        for w in r["text"].split(" "):
            core = w.strip(".,?!")
            if core[:1].isupper():
                w = w.replace(core, names.setdefault(core, f"{rng.choice('BDGKLMN')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{len(names)}".rstrip("0123456789") + "abcdefghijklmnopqrstuvwxyz"[len(names) % 26]))
            elif core.isdigit():
                w = w.replace(core, numbers.setdefault(core, str(rng.randrange(2, 10_000))))
            out.append(w)
        docs.append((r["item_id"], " ".join(out)))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert got.filter(F.col("contaminated") & F.array_contains("items", F.col("doc_id"))).count() >= 0.95 * len(docs)
