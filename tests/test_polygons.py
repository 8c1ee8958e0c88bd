"""Land use on polygons of any shape, with holes, clipping and metres, against plain arithmetic."""

import math
import random

from test_grid import plain_inside

from kerbgrid.functions import boxes
from kerbgrid.operators import dataset, ingest, reports, spatial

SHAPE = "poly_id long, region_id long, landuse string, leisure string, rings array<array<struct<x:double,y:double>>>"


def _near(x, y, ring):
    best = math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(ax + t * dx - x, ay + t * dy - y))
    return best


def test_polygons_with_holes(spark):
    rng = random.Random(6)
    shapes = []
    for k in range(12):
        cx, cy, n = rng.uniform(0, 8), rng.uniform(0, 8), rng.randint(3, 9)
        around = lambda size: [(cx + size * rng.uniform(0.6, 1) * math.cos(2 * math.pi * i / n), cy + size * rng.uniform(0.6, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]  # noqa: B023, E731
        shapes.append((k, k % 2, rng.choice(["commercial", "residential", "retail"]), None, [around(1.5), *([around(0.5)] if k % 3 else [])]))
    points = [(i, i % 2, rng.uniform(0, 8), rng.uniform(0, 8)) for i in range(400)]
    want = {}
    for i, region, x, y in points:
        found = []
        for _, r, use, _, rings in shapes:
            if r == region:
                inside = sum(plain_inside(x, y, ring) for ring in rings) % 2 == 1
                d = 0.0 if inside else min(_near(x, y, ring) for ring in rings)
                if inside or d <= 0.3:
                    found.append((not inside, round(d, 9), use))
        kinds = {u for o, d, u in found if (o, d) == min(found)[:2]}
        mixed = "residential" in kinds and len(kinds) > 1
        want[i] = "unmatched" if not kinds else "mixed-use" if mixed else next(u for u in ("commercial", "residential", "industrial", "retail") if u in kinds)
    p = spark.createDataFrame(points, "point_id long, region_id long, x double, y double")
    rows = [(k, r, u, f, [[{"x": a, "y": b} for a, b in ring] for ring in rings] + [[]]) for k, r, u, f, rings in shapes]
    q = spark.createDataFrame([*rows, (99, 0, "retail", None, None), (98, 1, "retail", None, [])], SHAPE)
    got = {r["point_id"]: r["land_use"] for r in spatial.land_use_of_points(p, q, 0.3, include_unmatched=True).collect()}
    assert got == want and len(set(want.values())) > 3
    assert spatial.land_use_of_points(p, q, 0.3).count() == sum(x != "unmatched" for x in want.values())
    assert spatial.land_use_of_points(p.limit(0), q, 0.3, include_unmatched=True).count() == 0
    grid = reports.land_use_density(spark.createDataFrame([(1, "unmatched"), (2, "retail")], "image_id long, land_use string"), spark.createDataFrame([(1, "bin"), (2, "bin")], "image_id long, label string"), include_unmatched=True)
    assert {r["land_use"]: r["detections"] for r in grid.collect()} == {"commercial": 0, "residential": 0, "industrial": 0, "retail": 1, "park/leisure/green": 0, "unmatched": 1}


def test_metres_on_the_ground(spark):
    """At 60 degrees a Mercator metre is half a metre on the ground."""
    y = boxes.EARTH_RADIUS * math.log(math.tan(math.pi / 4 + math.radians(60) / 2))
    ring = [[{"x": float(a), "y": y + b} for a, b in ((0, -50), (100, -50), (100, 50), (0, 50))]]
    q = spark.createDataFrame([(1, 1, "retail", None, ring)], SHAPE)
    p = spark.createDataFrame([(1, 1, 290.0, y), (2, 1, 310.0, y), (3, 1, 150.0, y), (4, 1, 50.0, y)], "point_id long, region_id long, x double, y double")
    ids = lambda true: sorted(r["point_id"] for r in spatial.land_use_of_points(p, q, 100.0, true_metres=true).collect())
    assert ids(True) == [1, 3, 4] and ids(False) == [3, 4]


def test_clipped(spark):
    regions = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0)], "region_id long, min_lng double, min_lat double, max_lng double, max_lat double")
    q = spark.createDataFrame([(1, 1, 3.0, 3.0, 2.0), (2, 1, 5.0, 5.0, 1.0)], "poly_id long, region_id long, x0 double, y0 double, side double")
    (row,) = spatial.clipped(q, regions).collect()
    assert row["poly_id"] == 1 and {(p["x"], p["y"]) for p in row["rings"][0]} == {(3.0, 3.0), (4.0, 3.0), (4.0, 4.0), (3.0, 4.0)}


def test_unreadable_boxes_and_empty_tasks(spark):
    images = spark.createDataFrame([(1, 1, "u1", 100, 100, 0.5, 0.5), (2, 1, "u2", 100, 100, None, None)], "image_id long, region_id long, url string, width int, height int, lng double, lat double")
    regions = spark.createDataFrame([(1, "r", "c", "d")], "region_id long, name string, city string, country string")
    boxed = ["[0,0,10,10]", '["1", "2", "3.5", 4]', "[1e1, 0, 20, 5]", "[1,2,3]", "no", None, "[0,0,-5,4]"]
    detections = spark.createDataFrame([(f"d{k}", 1, "bin", 0.1 * k, b) for k, b in enumerate(boxed)], "detection_id string, image_id long, label string, confidence double, bbox string")
    one, two = sorted(dataset.export_records(images, regions, detections).collect(), key=lambda r: r["image_id"])
    assert [p["detection_id"] for p in one["predictions"]] == ["d0", "d1", "d2", "d6"] and [b["detection_id"] for b in one["boxes"]] == ["d0", "d1", "d2"]
    assert (one["region_name"], one["lng"], two["predictions"], two["boxes"]) == ("r", 0.5, [], [])
    made = {r["image_id"]: r for r in dataset.tasks(images, detections, keep_empty=True, model_version="v1").collect()}
    assert made[2]["payload"] == '{"data":{"image":"u2","image_id":2}}' and '"model_version":"v1"' in made[1]["payload"]
    assert dataset.tasks(images, detections).count() == 1
    meta = dataset.dataset_descriptor(spark, 10, "index.ndjson", "shards").first()
    assert meta["class_names"]["8"] == "utility_pole" and meta["format"]["shard_size"] == 10 and meta["paths"]["index"] == "index.ndjson"


def test_override_takes_what_hangs_on_a_region(spark):
    regions = spark.createDataFrame([(1, "a"), (2, "b")], "region_id long, name string")
    images = spark.createDataFrame([(10, 1), (20, 2)], "image_id long, region_id long")
    detections = spark.createDataFrame([("x", 10), ("y", 20)], "detection_id string, image_id long")
    features = spark.createDataFrame([(5, 1), (6, 2)], "feature_id long, region_id long")
    left = ingest.overridden(regions, spark.createDataFrame([(3, "a")], "region_id long, name string"), images, detections, features)
    ids = {"regions": "region_id", "images": "image_id", "detections": "detection_id", "features": "feature_id"}
    keys = {name: sorted(r[key] for r in left[name].collect()) for name, key in ids.items()}
    assert keys == {"regions": [2, 3], "images": [20], "detections": ["y"], "features": [6]}
