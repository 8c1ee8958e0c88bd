"""The grid of many levels against plain loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbgrid.operators import grid, spatial

POINT = "point_id long, x double, y double"
SHAPE = "poly_id long, rings array<array<struct<x:double,y:double>>>"


def plain_inside(x, y, ring):
    """Ray cast; points on an edge are outside."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return False
        if (ay > y) != (by > y):
            odd ^= x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def plain_shape(x, y, rings):
    on = any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for r in rings for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]))
    return not on and sum(plain_inside(x, y, r) for r in rings) % 2 == 1


def star(rng, cx, cy, size, n, low=0.3):
    return [(cx + size * rng.uniform(low, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(low, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def rows_of(shapes):
    return [(k, [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]) for k, rings in shapes]


def pairs(spark, points, shapes):
    near = grid.met(spark.createDataFrame(points, POINT), spark.createDataFrame(rows_of(shapes), SHAPE), "point_id", "poly_id", "x", "y")
    return sorted(tuple(r) for r in near.select("point_id", "poly_id").collect())


def test_rings_of_all_sizes_with_holes(spark):
    rng = random.Random(8)
    shapes = [(k, [star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), 10 ** rng.uniform(-1, 1.3), rng.choice([3, 4, 9, 40, 400]))]) for k in range(25)]
    shapes = [(k, [*r, star(rng, r[0][0][0] - 1, r[0][0][1], 0.4, 30)] if k % 4 == 0 else r) for k, r in shapes]
    points = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(800)] + [(1000 + i, *shapes[i % 25][1][0][i % 3]) for i in range(60)]
    want = sorted((i, k) for i, x, y in points for k, rings in shapes if plain_shape(x, y, rings))
    assert pairs(spark, points, shapes) == want and len(want) > 100


def test_whole_number_rings_whose_corners_lie_on_borders_of_cells(spark):
    rng = random.Random(3)
    staircase = [(0, 0)]
    for i in range(40):
        staircase += [(i + 1, i), (i + 1, i + 1)]
    comb = [(0, 0), *[p for i in range(30) for p in ((2 * i, 50), (2 * i + 1, 50), (2 * i + 1, 1), (2 * i + 2, 1))], (60, 0)]
    shapes = [(1, [[*staircase, (0, 40)]]), (2, [comb]), (3, [[(0, 0), (8, 0), (8, 8), (0, 8)]]), (4, [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2)]]), (5, [[(1, 1), (1, 1)]]), (6, [[]]), (7, [[(0, 0), (4, 0), (0, 0), (0, 4)]])]
    points = [(i, rng.randrange(-2, 130) / 2, rng.randrange(-2, 110) / 2) for i in range(900)]
    want = sorted((i, k) for i, x, y in points for k, rings in shapes if plain_shape(float(x), float(y), rings))
    assert pairs(spark, points, shapes) == want and {k for _, k in want} >= {1, 2, 3, 4}


def test_a_ring_of_many_edges_is_shuffled_in_proportion_to_them(spark):
    n = 10_000
    ring = [(100 * math.cos(2 * math.pi * i / n) * (1 + 0.05 * math.sin(40 * math.pi * i / n)), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    cells, copies, most = grid.cut(grid.placed(grid.with_edges(spark.createDataFrame(rows_of([(1, [ring])]), SHAPE)).withColumn("reach", F.lit(0.0))), "poly_id").agg(F.count("*"), F.sum(F.size("edges")), F.max(F.size("edges"))).first()
    assert cells < n and copies < 2 * n and most < 120
    rng = random.Random(1)
    points = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(60)]
    assert pairs(spark, points, [(1, [ring])]) == sorted((i, 1) for i, x, y in points if plain_shape(x, y, [ring]))


def test_points_in_squares_and_regions(spark):
    rng = random.Random(4)
    points = [(i, rng.randrange(100) / 10, rng.randrange(100) / 10) for i in range(150)]
    squares = [(k, rng.randrange(90) / 10, rng.randrange(90) / 10, rng.choice([0.3, 0.5, 1.5, 40.0])) for k in range(40)]
    corners = lambda a, b, s: [(a, b), (a + s, b), (a + s, b + s), (a, b + s)]
    p = spark.createDataFrame(points, POINT)
    q = spark.createDataFrame(rows_of([(k, [corners(a, b, s)]) for k, a, b, s in squares]), SHAPE)
    want = {i for i, x, y in points for _, a, b, s in squares if a < x < a + s and b < y < b + s}
    assert {r["point_id"] for r in spatial.points_in_any(p, q).collect()} == want
    regions = spark.createDataFrame([(k, a, b, a + s, b + s, k % 2 == 0) for k, a, b, s in squares], "region_id long, min_lng double, min_lat double, max_lng double, max_lat double, dense_scan boolean")
    place = p.select("point_id", F.col("x").alias("lng"), F.col("y").alias("lat"))
    for dense in (None, True):
        held = {i: min(((s * s, k) for k, a, b, s in squares if a <= x <= a + s and b <= y <= b + s and (dense is None or k % 2 == 0)), default=(0, None)) for i, x, y in points}
        got = {r["point_id"]: r["region_id"] for r in spatial.regions_at_points(place, regions, dense=dense).collect()}
        areas = {k: s * s for k, _, _, s in squares}
        assert all((g is None) == (held[i][1] is None) and (g is None or areas[g] == pytest.approx(held[i][0])) for i, g in got.items()) and len(got) == len(points)
    assert spatial.points_in_any(p, q.limit(0)).count() == 0
