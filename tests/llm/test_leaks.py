"""Items that a document holds several times, and items without a window."""

from kerbgrid.llm import decontaminate

TRAIN = "A train leaves {} at {} and runs {} km to {}, how long does it take at {} km an hour?"
FRUIT = "Tom gives {} {} apples and {} {} pears, how many fruits do {} and {} hold now?"


def _fruit(a, m, b, n):
    return FRUIT.format(a, m, b, n, a, b)


def held(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = None
    for limit in (decontaminate.BROADCAST_ROWS, -1):
        old, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, limit
        got = {r["doc_id"]: (r["items"], r["reparameterised"]) for r in decontaminate.contamination(docs, bench).collect()}
        decontaminate.BROADCAST_ROWS = old
        assert out in (None, got)
        out = got
    return [out[i] for i in range(len(texts))]


def test_items_held_several_times(spark):
    train = [TRAIN.format(*x) for x in (("Berlin", 9, 120, "Prague", 60), ("Madrid", 7, 350, "Lisbon", 70), ("Oslo", 5, 400, "Bergen", 80))]
    fruit = [_fruit(*x) for x in (("Ann", 3, "Bob", 5), ("Eve", 4, "Max", 9), ("Zoe", 8, "Kim", 2))]
    mixed = _fruit("Eve", 4, "Max", 9).replace("do Eve and Max", "do Kim and Zoe")
    longer = train[1].replace("and runs", "and then runs").replace("does it take", "does it then take")
    texts = [f"{x[0]} {x[1]}" for x in (train, fruit)] + [f"{x[1]} {x[2]}" for x in (train, fruit)] + [" Words between. ".join(train), train[0] + " " + longer, mixed, "Nothing of it is here."]
    got = held(spark, texts, [train[0], fruit[0]])
    assert got == [([0], False), ([1], False), ([0], True), ([1], True), ([0], False), ([0], False), ([], False), ([], False)]


def test_items_without_a_window(spark):
    items = ["What is 12 + 34?", "Add 12, 34, 56, 78 and 90.", "Did Anna Smith or Paul Jones meet 14 times?", "Add the numbers 5"]
    texts = [
        "Question: what is 12 + 34? Say it.", "Now. Add 12, 34, 56, 78 and 90. Done.", "Well. Did Anna Smith or Paul Jones meet 14 times? No.", "Exercise. Did Eve Long or Max Short meet 3 times? Yes.",
        "What is 5 + 6? Nobody knows.", "Add 1, 2, 3, 4 and 5.", "Did Anna Smith or Paul Smith meet 14 times?", "Did Eve Long or Max Short see it 3 times?", "", "Please. Add the numbers 7 today.",
    ]
    got = held(spark, texts, items)
    assert got == [([0], False), ([1], False), ([2], False), ([2], True), ([], False), ([], False), ([2], True), ([], False), ([], False), ([3], True)]
