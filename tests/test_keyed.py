"""Appends by key filters: what they add, what they refuse and which files they read."""

import pytest

from kerbgrid.operators import keyed
from kerbgrid.scratch import deleted
from kerbgrid.streaming import jobs

SHAPE = "id_from_source string, image_id long, status string"


def rows(spark, ids, status="new"):
    return spark.createDataFrame([(None if i is None else f"s{i:06d}", i or 0, status) for i in ids], SHAPE)


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "images")
    keyed.create(rows(spark, range(4000)), path, "id_from_source", buckets=4)
    for start in (4000, 7000):  # later files hold later keys
        assert keyed.appended(spark, path, rows(spark, range(start, start + 3000)), "image_id")[0] == 3000
    return path


def statuses(spark, path):
    return sorted((r["id_from_source"] or "", r["status"]) for r in keyed.read(spark, path).collect())


def test_duplicates_are_refused_and_the_first_of_a_key_counts(spark, path):
    batch = rows(spark, [5, 9999, 10001], "again").unionByName(rows(spark, [10001, None, None], "other"))
    before = statuses(spark, path)
    n, _ = keyed.appended(spark, path, batch, "status")
    assert n == 3
    assert statuses(spark, path) == sorted([*before, ("s010001", "again"), ("", "other"), ("", "other")])


def test_files_read_fall_with_the_batch(spark, path):
    everything = len(keyed._files(spark, path))
    one = keyed.candidates(spark, path, rows(spark, [4321]))
    assert len(one) == 1 and keyed._read(spark, path, one).filter("id_from_source = 's004321'").count() == 1
    assert len(keyed.candidates(spark, path, rows(spark, range(20000, 20400)))) == 0  # beyond all ranges
    assert len(keyed.candidates(spark, path, rows(spark, range(6000, 6500)))) < everything / 2
    n, read = keyed.appended(spark, path, rows(spark, [7777]), "image_id")
    assert (n, read) == (0, 1)
    # Within a file's range but not in it: bits decide, with a few hits by chance.
    between = spark.createDataFrame([(f"s{i:06d}x", i, "") for i in range(0, 9000, 9)], SHAPE)
    pairs = keyed.filters(spark, path)
    assert pairs.filter("word >= 0").count() > 0 and len(keyed.candidates(spark, path, between.limit(20))) <= 4


def test_no_key_is_missed(spark, path):
    held = keyed.read(spark, path)
    for start in range(0, 10000, 2500):
        part = held.filter(f"image_id >= {start} AND image_id < {start + 2500}")
        assert keyed.appended(spark, path, part, "image_id")[0] == 0
    assert keyed.read(spark, path).count() == 10000


def test_files_that_lost_their_filters_are_read_and_get_them_again(spark, path):
    deleted(spark, f"{path}/_filters")
    kept = spark.createDataFrame([], "bucket int, file string, level int, low string, high string, word long, bits long")
    kept.write.parquet(f"{path}/_filters")
    assert len(keyed.candidates(spark, path, rows(spark, [1]))) == len(keyed._files(spark, path))
    assert keyed.appended(spark, path, rows(spark, [1]), "image_id")[0] == 0
    assert len(keyed.candidates(spark, path, rows(spark, [1]))) == 1
    assert keyed.refiltered(spark, path) == 0


def test_a_table_may_start_empty_and_batches_too(spark, tmp_path):
    path = str(tmp_path / "empty")
    keyed.create(rows(spark, []), path, "id_from_source")
    assert keyed.appended(spark, path, rows(spark, []), "image_id") == (0, 0)
    assert keyed.appended(spark, path, rows(spark, [1, 1, 2]), "image_id")[0] == 2
    assert keyed.appended(spark, path, rows(spark, [1, 3]), "image_id")[0] == 1
    assert keyed.read(spark, path).count() == 3


def test_a_stream_appends_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    path, landing = str(tmp_path / "table"), str(tmp_path / "landing")
    keyed.create(rows(spark, range(50)), path, "id_from_source", buckets=4)
    rows(spark, [*range(40, 60), None], "late").coalesce(1).write.mode("append").parquet(landing)
    for check in ("one", "two"):  # a lost checkpoint repeats all batches
        stream = spark.readStream.schema(SHAPE).parquet(landing)
        jobs.append_keyed(stream, path, str(tmp_path / check)).awaitTermination()
        assert statuses(spark, path) == sorted([(f"s{i:06d}", "new") for i in range(50)] + [(f"s{i:06d}", "late") for i in range(50, 60)])
