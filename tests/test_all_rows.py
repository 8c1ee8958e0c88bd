"""The queries over all regions against the views' rows, by plain Python."""

import pytest

from kerbgrid.operators import ingest
from kerbgrid.plans import queries
from kerbgrid.plans.fixtures import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    v = Views(spark, SF)
    return {x: getattr(v, x).collect() for x in ("images", "detections", "landuse_polygons")}


def test_all_rows(spark, rows):
    got = {x: [tuple(r) for r in queries.QUERIES[x](spark, SF).collect()] for x in ("task_flatten", "bbox_polygon_filter", "refresh_tally", "images_with_detections", "unreviewed")}
    images, found = {r["image_id"]: r for r in rows["images"]}, [r for r in rows["detections"]]
    tasks = {}
    for d in found:
        if d["image_id"] in images:
            a, n = tasks.get(d["image_id"], (0, 0))
            tasks[d["image_id"]] = (a + d["manual_reviewed"], n + 1)
    assert sorted(got["task_flatten"]) == sorted((i, *x) for i, x in tasks.items())
    inside = lambda i, p: p["x0"] < i["lng"] < p["x0"] + p["side"] and p["y0"] < i["lat"] < p["y0"] + p["side"]
    assert sorted(got["bbox_polygon_filter"]) == sorted((k,) for k, i in images.items() if any(inside(i, p) for p in rows["landuse_polygons"]))
    kinds = [k % 7 for k in images]
    assert got["refresh_tally"] == [(len(kinds), sum(k > 1 for k in kinds), kinds.count(1), kinds.count(0))]
    held = {d["image_id"] for d in found}
    assert sorted(got["images_with_detections"]) == sorted((k, i["region_id"]) for k, i in images.items() if k in held)
    assert len({i[1] for i in got["images_with_detections"]}) > 5
    assert sorted(got["unreviewed"]) == sorted((d["detection_id"], d["label"]) for d in found if d["manual_reviewed"] == 0)


def test_one_region_and_status(spark, rows):
    v = Views(spark, SF)
    of = {i["image_id"] for i in rows["images"] if i["region_id"] == 4}
    seen = {i["image_id"] for i in rows["images"] if i["status"] == "reviewed"}
    held = {d["image_id"] for d in rows["detections"]}
    assert {r["image_id"] for r in ingest.with_detections(v.images, v.detections, 4, "reviewed").collect()} == of & seen & held
    assert {r["detection_id"] for r in ingest.unreviewed_detections(v.images, v.detections, 4).collect()} == {d["detection_id"] for d in rows["detections"] if d["image_id"] in of and d["manual_reviewed"] == 0}
