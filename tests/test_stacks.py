"""Points at one place and shapes that repeat: what meets on the grid is in proportion to distinct ones."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_grid import SHAPE, rows_of

from kerbgrid.operators import grid, keyed, shapes, spatial
from kerbgrid.plans import queries

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
TRIANGLE = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]


@pytest.fixture
def met_rows(monkeypatch):
    """Numbers of points and shapes of each join on the grid."""
    seen, joined = [], grid.joined_on_grid

    def counted(points, shapes, *rest):
        seen.append((points.count(), shapes.count()))
        return joined(points, shapes, *rest)

    monkeypatch.setattr(grid, "joined_on_grid", counted)
    return seen


def stacked(spark):
    """200 points at 3 places, and one without a place."""
    at = F.when(F.col("point_id") % 4 == 3, 9.0).when(F.col("point_id") % 2 == 0, 1.0).otherwise(2.1)
    points = spark.range(200).select(F.col("id").alias("point_id"), F.lit(1).cast("long").alias("region_id")).withColumn("x", at).withColumn("y", F.lit(1.0))
    return points.unionByName(spark.createDataFrame([(200, 1, None, 1.0)], "point_id long, region_id long, x double, y double"))


@pytest.mark.parametrize("form", ["box", "ring", "triangle"])
def test_land_use_of_stacked_points_and_polygons(spark, met_rows, form):
    tags = F.when(F.col("poly_id") % 2 == 0, "retail").otherwise("residential")
    polygons = spark.range(90).select(F.col("id").alias("poly_id"), F.lit(1).cast("long").alias("region_id")).withColumns({"landuse": tags, "leisure": F.lit(None).cast("string"), "x0": F.lit(0.0), "y0": F.lit(0.0), "side": F.lit(2.0)})
    if form != "box":
        ring = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (SQUARE if form == "ring" else TRIANGLE)])
        polygons = polygons.drop("x0", "y0", "side").withColumn("rings", F.array(ring))
    for include in (True, False):
        got = {r["point_id"]: r["land_use"] for r in spatial.land_use_of_points(stacked(spark), polygons, 0.2, include_unmatched=include).collect()}
        assert got == {i: "unmatched" if i % 4 == 3 or i == 200 else "mixed-use" for i in range(201) if include or i % 4 != 3 and i != 200}
    assert all(p <= 4 and s <= 9 for p, s in met_rows) and met_rows


def test_points_in_any_of_stacked_polygons(spark, met_rows):
    polygons = spark.createDataFrame(rows_of([(k, [SQUARE]) for k in range(80)]), SHAPE)
    got = spatial.points_in_any(stacked(spark), polygons)
    assert got.columns == ["point_id", "region_id", "x", "y"] and sorted(r["point_id"] for r in got.collect()) == list(range(0, 200, 2))
    assert met_rows and all(p <= 4 and s <= 9 for p, s in met_rows)


def test_combs_are_counted_where_images_and_combs_are_stacked(spark, met_rows):
    images = stacked(spark).select(F.col("point_id").alias("image_id"), F.col("x").alias("lng"), F.col("y").alias("lat"))
    polygons = spark.createDataFrame([(k, 0.0, 0.0, 6.0 if k % 3 else 40.0) for k in range(60)], "poly_id long, x0 double, y0 double, side double")
    got = {tuple(r) for r in queries.points_in_combs(SimpleNamespace(images=images, landuse_polygons=polygons)).collect()}
    assert got == {(i, 60, 0) if i % 4 != 3 else (i, 20, 0) for i in range(200)}
    assert met_rows and all(p <= 4 and s <= 200 for p, s in met_rows)


def test_polygons_are_dealt_before_their_edges_are_summed(spark):
    polygons = spark.createDataFrame(rows_of([(k, [SQUARE]) for k in range(8)]), SHAPE).withColumn("use", F.lit("a"))
    plan = shapes.border_edges(polygons.coalesce(1), ["use"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.rindex("Exchange hashpartitioning") > plan.rindex("Generate")


def test_keys_of_a_table_meet_a_broadcast_row_a_file(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.range(5000).withColumnRenamed("id", "k"), path, "k", 4)
    plan = keyed._filtered(keyed._read(spark, path, list(keyed._files(spark, path).values())), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    keys = spark.range(10)
    asked = keyed.candidates(spark, path, keys.withColumnRenamed("id", "k"))
    assert asked and keyed.appended(spark, path, keys.withColumnRenamed("id", "k"), "k")[0] == 0
