"""Clipping, regions and dissolving against plain arithmetic on grids and rectangles."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_grid import SHAPE, plain_shape, rows_of, star

from kerbgrid.operators import shapes, spatial
from kerbgrid.sources import readers

BOXES = "region_id long, min_lng double, min_lat double, max_lng double, max_lat double"


def area(ring):
    return sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) / 2


def points_of(ring):
    return [(p["x"], p["y"]) for p in ring]


def test_clipped_rings_hold_the_same_points_inside_the_box(spark):
    rng = random.Random(2)
    polygons = [(k, [star(rng, rng.uniform(-1, 5), rng.uniform(-1, 5), 3, rng.choice([3, 8, 30]))]) for k in range(20)]
    polygons = [(k, [r[0], star(rng, 2, 2, 0.5, 5)] if k % 3 == 0 else r) for k, r in polygons]
    regions = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 4.0, 0.0, 8.0, 4.0), (3, -50.0, -50.0, 50.0, 50.0)], BOXES)
    got = {(r["region_id"], r["poly_id"]): [points_of(x) for x in r["rings"]] for r in shapes.regional(spark.createDataFrame(rows_of(polygons), SHAPE), regions).collect()}
    boxes = {1: (0, 0, 4, 4), 2: (4, 0, 8, 4), 3: (-50, -50, 50, 50)}
    for _ in range(300):
        x, y = rng.uniform(-3, 9), rng.uniform(-3, 7)
        for r, (a, b, c, d) in boxes.items():
            for k, rings in polygons:
                want = a < x < c and b < y < d and plain_shape(x, y, rings)
                assert want == ((r, k) in got and plain_shape(x, y, got[r, k]))
    assert all(got[3, k] == [[(float(a), float(b)) for a, b in x] for x in rings] for k, rings in polygons)
    assert all(a <= x <= c and b <= y <= d for (r, _), rings in got.items() for x, y in rings[0] for a, b, c, d in [boxes[r]])


def test_landed_polygons_reach_the_land_use_of_points(spark, tmp_path):
    square = lambda a, b, s: [[a, b], [a + s, b], [a + s, b + s], [a, b + s], [a, b]]
    features = [
        {"id": "yard", "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 6), square(2, 2, 2)]}, "properties": {"landuse": "retail"}},
        {"id": "two", "geometry": {"type": "MultiPolygon", "coordinates": [[square(8, 8, 1)], [square(20, 20, 1)]]}, "properties": {"leisure": "park"}},
        {"id": "none", "geometry": {"type": "Point", "coordinates": [1, 1]}, "properties": {"landuse": "retail"}},
        {"id": "empty", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {"landuse": "retail"}},
    ]
    (tmp_path / "land.json").write_text(json.dumps({"features": features}))
    landed = readers.polygon_pages(spark, str(tmp_path / "land.json"))
    regions = spark.createDataFrame([(7, 0.0, 0.0, 5.0, 5.0), (8, 5.0, 0.0, 10.0, 10.0)], BOXES)
    cut = shapes.regional(landed, regions)
    sizes = {(r["region_id"], r["poly_id"], r["part"]): [abs(area(points_of(x))) for x in r["rings"]] for r in cut.collect()}
    assert sizes == {(7, "yard", 0): [25.0, 4.0], (8, "yard", 0): [6.0], (8, "two", 0): [1.0]}
    points = spark.createDataFrame([(1, 7, 1.0, 1.0), (2, 7, 3.0, 3.0), (3, 8, 5.5, 3.0), (4, 8, 8.5, 8.5), (5, 8, 20.5, 20.5)], "point_id long, region_id long, x double, y double")
    named = cut.withColumn("poly_id", F.concat_ws(":", "poly_id", "part", "region_id"))
    got = {r["point_id"]: r["land_use"] for r in spatial.land_use_of_points(points, named, 0.0, include_unmatched=True).collect()}
    assert got == {1: "retail", 2: "unmatched", 3: "retail", 4: "park/leisure/green", 5: "unmatched"}


def cells(cells_, size=1.0):
    return [(k, [[(x * size, y * size), (x * size + size, y * size), (x * size + size, y * size + size), (x * size, y * size + size)][:: 1 if k % 2 else -1]]) for k, (x, y) in enumerate(cells_)]


def dissolve(spark, polygons):
    df = spark.createDataFrame(rows_of(polygons), SHAPE).withColumn("use", F.lit("a"))
    return [points_of(r["ring"]) for r in shapes.dissolved(df, ["use"]).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_dissolved_squares_keep_area_and_borders(spark, seed):
    rng = random.Random(seed)
    held = {(x, y) for x in range(9) for y in range(9) if rng.random() < 0.6}
    rings = dissolve(spark, cells(sorted(held)))
    assert sum(map(area, rings)) == len(held)
    border = Counter(frozenset(e) for r in rings for e in zip(r, r[1:] + r[:1]))
    want = {frozenset(e) for x, y in held for n, e in {(x - 1, y): ((x, y), (x, y + 1)), (x + 1, y): ((x + 1, y), (x + 1, y + 1)), (x, y - 1): ((x, y), (x + 1, y)), (x, y + 1): ((x, y + 1), (x + 1, y + 1))}.items() if n not in held}
    assert set(border) == want and set(border.values()) == {1}
    # each group of squares that share sides has one outline, also where groups touch at corners
    groups, left = 0, set(held)
    while left:
        groups, stack = groups + 1, [left.pop()]
        while stack:
            x, y = stack.pop()
            for n in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
    assert sum(area(r) > 0 for r in rings) == groups


def test_dissolved_slices_holes_and_classes(spark):
    n = 700  # slices of a disc with a hole: two rings of many edges
    at = lambda r, i: (r * math.cos(2 * math.pi * (i % n) / n), r * math.sin(2 * math.pi * (i % n) / n))
    slices = [(i, [[at(1, i), at(2, i), at(2, i + 1), at(1, i + 1)]]) for i in range(n)]
    rings = dissolve(spark, slices)
    assert sorted(map(len, rings)) == [n, n] and sum(map(area, rings)) == pytest.approx(n / 2 * math.sin(2 * math.pi / n) * 3)
    # a hole that another polygon fills is gone; other classes do not dissolve
    frame, core = (1, [[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (2, 1), (2, 2), (1, 2)]]), (2, [[(1, 1), (2, 1), (2, 2), (1, 2)]])
    assert sorted(map(area, dissolve(spark, [frame, core]))) == [9.0]
    df = spark.createDataFrame(rows_of([frame, core]), SHAPE).withColumn("use", F.col("poly_id"))
    assert sorted(r["area"] for r in shapes.dissolved(df, ["use"]).collect()) == [-1.0, 1.0, 9.0]
    assert shapes.dissolved(df.limit(0), ["use"]).count() == 0
