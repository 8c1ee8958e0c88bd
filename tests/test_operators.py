"""Operators on small frames, replays, property checks and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbgrid.operators import dataset, ingest, inference, reports, score, spatial

IMAGES = "image_id long, region_id long, id_from_source string, status string"


def test_scores_of_odd_regions(spark):
    images = spark.createDataFrame([(i, i % 4) for i in range(8)], "image_id long, region_id long")
    rows = [(0, "billboard"), (4, "other"), (1, "other"), (2, "road_sign")]  # 3: no detections
    found = spark.createDataFrame(rows, "image_id long, label string")
    got = {r["region_id"]: r["vpi"] for r in score.detection_index(images, found, 1).collect()}
    assert got == {0: pytest.approx(1 / 9 * 0.9 / 2), 1: 0.0, 2: 0.0, 3: 0.0}
    assert {r["vpi"] for r in score.detection_index(images, found, 3).collect()} == {0.0}
    none = spark.createDataFrame([], "feature_id long, region_id long, osm_type string")
    got = {r["region_id"]: r["vpi_osm"] for r in score.blended_index(images, found, none, min_images=None, min_features=None).collect()}
    assert got[0] == pytest.approx(0.05)
    assert {r["score"] for r in score.score_region(images, found, none, 0, "unknown").collect()} == {0.0}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a", "reviewed")], IMAGES)
    batch = spark.createDataFrame([(2, 1, "a", None), (3, 1, "b", None), (4, 1, "b", None), (5, 1, None, None), (6, 1, None, None)], IMAGES)
    once = ingest.upsert_images(old, batch)
    assert sorted((r["image_id"], r["status"]) for r in once.collect()) == [(1, "reviewed"), (3, "unreviewed"), (5, "unreviewed"), (6, "unreviewed")]
    assert ingest.upsert_images(once, batch.filter("id_from_source is not null")).count() == 4


def test_patch_and_reset(spark):
    rows = spark.createDataFrame([(1, 1, "a", "reviewed"), (2, 1, "b", "failed")], IMAGES)
    assert [r["status"] for r in ingest.set_status(rows, rows.filter("image_id = 1"), "new").orderBy("image_id").collect()] == ["new", "failed"]
    assert [r["status"] for r in ingest.reset_detections(rows, rows)[0].orderBy("image_id").collect()] == ["unreviewed", "failed"]


def test_regions_admitted(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "region_id long, name string")
    new = spark.createDataFrame([(3, "b"), (4, "c")], "region_id long, name string")
    ids = lambda df: sorted(r["region_id"] for r in df.collect())
    assert ids(ingest.admitted_regions(old, new)) == [1, 2, 4] and ids(ingest.admitted_regions(old, new, True)) == [1, 3, 4]
    assert ingest.regions_by_city(old.withColumn("city", F.lit("x")).withColumn("country", F.lit("y"))).count() == 0


@pytest.mark.parametrize(("n", "cells"), [(60, 60), (1000, 1000), (9, 9), (1, 1)])
def test_tiles(spark, n, cells):
    box = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 5.0), (2, 1.0, 1.0, 1.0, 2.0)], "region_id long, min_lng double, min_lat double, max_lng double, max_lat double")
    area = lambda df: df.agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).first()[0]
    assert spatial.tiles(box, n).count() == cells
    assert area(spatial.tiles(box, n, truncate=False)) == pytest.approx(50.0)


def test_split_totals_are_exact(spark):
    rows = spark.range(137).select(F.col("id").alias("image_id"))
    boxes = spark.createDataFrame([(i, i % 3, k) for i in range(100) for k in range(1 + i % 2)], "image_id long, class_id int, detection_id long")
    split = dataset.balanced_split(rows, boxes)
    assert {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 95, "val": 27, "test": 15}
    share = split.groupBy("stratum").agg(F.avg((F.col("split") == "train").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.7) < 0.08 for r in share)
    assert dataset.balanced_split(rows.limit(0), boxes).count() == 0


def test_shards_and_sample(spark):
    rows = spark.range(25).select(F.col("id").alias("image_id"))
    got = dataset.shard_index(rows, 10).orderBy("image_id").collect()
    assert [r["shard"] for r in got] == ["shard-000000.tar"] * 10 + ["shard-000001.tar"] * 10 + ["shard-000002.tar"] * 5
    assert [r["member"] for r in got] == [f"{i:08d}" for i in range(25)]
    with pytest.raises(ValueError):
        dataset.shard_index(rows, 0)
    images = rows.withColumn("region_id", F.col("image_id") % 2)
    regions = spark.createDataFrame([(0, "A"), (1, "B")], "region_id long, country string")
    a = dataset.sample_per_country(images, regions, 3, 1)
    assert {tuple(r) for r in a.select("country", "image_id").collect()} == {tuple(r) for r in dataset.sample_per_country(images, regions, 3, 1).select("country", "image_id").collect()} and a.count() == 6
    assert dataset.sample_of_region(images, 1, 99).count() == 12


def test_layers(spark):
    none = spark.createDataFrame([(1, 0.0)], "region_id long, s double")
    assert reports.min_max_normalised(none, "s").count() == 0
    equal = spark.createDataFrame([(1, 2.0), (2, 2.0)], "region_id long, s double")
    assert {r["share"] for r in reports.min_max_normalised(equal, "s").collect()} == {1.0}
    rows = spark.createDataFrame([(1, "a", None, "x"), (1, "b", 0.5, "y"), (1, "a", 0.5, "z")], "image_id long, label string, confidence double, detection_id string")
    assert tuple(reports.best_detection(rows).first()) == (1, 3, "a", 0.5)


def test_failures_stay_with_their_image(spark):
    def make_scorer():
        def run(rows):
            if (rows["image_id"] == 5).any():
                raise ValueError
            return [[{"class_id": 1, "confidence": 0.9, "bbox": [0.0, 0.0, 1.0, 1.0]}] for _ in rows["image_id"]]

        return run

    out = inference.scored(spark.range(40).select(F.col("id").alias("image_id")), make_scorer)
    assert {r["image_id"] for r in out.filter("outcome = 'failed'").collect()} == {5}
    assert inference.detection_rows(out).count() == 39
