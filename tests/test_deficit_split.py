"""The class-balanced draw: exact totals, and classes near their shares."""

import random
from collections import Counter

import pytest

from kerbgrid.operators import dataset


def draw(spark, n, boxes):
    images = spark.createDataFrame([(i,) for i in range(n)], "image_id long")
    found = spark.createDataFrame(boxes, "image_id long, class_id int")
    return {r["image_id"]: r["split"] for r in dataset.deficit_split(images, found).collect()}


def test_totals_are_exact_and_classes_within_a_box(spark):
    rng = random.Random(1)
    boxes = [(i, rng.choice([0, 0, 0, 1, 1, 2, 3])) for i in range(600) for _ in range(rng.randrange(0, 4))]
    split = draw(spark, 600, boxes)
    assert Counter(split.values()) == {"train": 420, "val": 120, "test": 60} and len(split) == 600
    total, got = Counter(k for _, k in boxes), Counter((split[i], k) for i, k in boxes)
    rarest = sorted(total, key=lambda k: (total[k], k))
    for s, share in (("train", 0.7), ("val", 0.2), ("test", 0.1)):
        for place, k in enumerate(rarest):
            # the rarest class is cut to the nearest box; later ones also by the images' other classes and sizes
            assert abs(got[s, k] - share * total[k]) <= (2 if place == 0 else 8)


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_few_images(spark, n):
    split = Counter(draw(spark, n, [(i, i % 2) for i in range(n)]).values())
    want = {"train": int(n * 0.7), "val": int(n * 0.2)}
    want["test"] = n - sum(want.values())
    assert split == {k: v for k, v in want.items() if v}


def test_images_without_boxes_and_boxes_without_images(spark):
    split = draw(spark, 10, [(99, 1)])
    assert Counter(split.values()) == {"train": 7, "val": 2, "test": 1}
    one = draw(spark, 100, [(i, 5) for i in range(10)])
    assert Counter(one[i] for i in range(10)) == {"train": 7, "val": 2, "test": 1} and Counter(one.values()) == {"train": 70, "val": 20, "test": 10}
