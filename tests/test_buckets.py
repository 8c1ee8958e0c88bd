"""Mutations of tables in buckets: what is read, what is rewritten, and what a repeat does."""

import os

import pytest

from kerbgrid.operators import buckets


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "images")
    rows = [(i, i % 10, "new", None if i % 3 else "u") for i in range(500)]
    buckets.create(spark.createDataFrame(rows, "image_id long, region_id long, status string, url string"), path)
    return path


def held(spark, path):
    return {r["image_id"]: (r["region_id"], r["status"], r["url"]) for r in buckets.read(spark, path).collect()}


def test_a_patch_rewrites_its_buckets_and_a_repeat_none(spark, table):
    before, old = held(spark, table), files(table)
    changes = spark.createDataFrame([(2, 12, "seen", None), (2, 22, None, None), (2, 9999, "lost", None), (3, 14, "elsewhere", None)], "region_id long, image_id long, status string, url string")
    touched = buckets.patched(spark, table, changes, "image_id")
    assert len(touched) == 1 and held(spark, table) == before | {12: (2, "seen", before[12][2])}
    new = files(table)
    assert {f: t for f, t in old.items() if f"bucket={touched[0]}/" not in f} == {f: t for f, t in new.items() if f"bucket={touched[0]}/" not in f}
    assert buckets.patched(spark, table, changes, "image_id") == [] and files(table) == new


def test_deletes_prune_and_empty_buckets_go(spark, table):
    before = held(spark, table)
    gone = spark.createDataFrame([(4,), (77,)], "region_id long")
    assert len(buckets.removed(spark, table, gone)) == 1
    assert held(spark, table) == {i: v for i, v in before.items() if v[0] != 4}
    assert buckets.removed(spark, table, gone) == []
    one = spark.createDataFrame([(5, 15)], "region_id long, image_id long")
    buckets.removed(spark, table, one)
    assert held(spark, table) == {i: v for i, v in before.items() if v[0] != 4 and i != 15}
    plan = buckets.read(spark, table, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60]


def test_appends_add_files_and_refuse_what_is_held(spark, table):
    before, old = held(spark, table), files(table)
    batch = spark.createDataFrame([(12, 2, "again", None), (700, 2, "fresh", None), (700, 2, "fresh", "zz")], "image_id long, region_id long, status string, url string")
    assert buckets.appended(spark, table, batch, "image_id", "status") == 1
    assert held(spark, table).keys() == before.keys() | {700} and old.items() <= files(table).items()
    assert buckets.appended(spark, table, batch, "image_id", "status") == 0 and len(held(spark, table)) == 501
