"""Landed inputs, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kerbgrid.operators import dataset
from kerbgrid.sources import readers, writers
from kerbgrid.streaming import jobs


def test_city_lists(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('London,United Kingdom,GBR,2020-01-01,2021-01-01\n\n"Edinburgh, City of",UK,GBR\nX,Y,Z,,\n')
    got = [tuple(r) for r in readers.positional_cities(spark, str(tmp_path / "plain.csv")).collect()]
    assert got == [("London", "United Kingdom", "GBR", "2020-01-01", "2021-01-01"), ("Edinburgh, City of", "UK", "GBR", None, None), ("X", "Y", "Z", None, None)]
    (tmp_path / "headed.csv").write_text("city,lat,lng,country,iso3,population,start_date\n A ,1,2,B,gbr,1000.7,2020\nC,x,,D,pol\n")
    a, c = readers.headed_cities(spark, str(tmp_path / "headed.csv")).collect()
    assert (a["city"], a["iso3"], a["lat"], a["population"], a["start_captured_at"]) == ("A", "GBR", 1.0, 1000, "2020")
    assert (c["lat"], c["lng"], c["population"]) == (None, None, None)
    assert readers.headed_cities(spark, str(tmp_path / "headed.csv"), 500).count() == 1


def test_image_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"id": 7, "computed_geometry": {"coordinates": [1.5, 2.5]}, "thumb_1024_url": "u", "captured_at": 1577836800000}, {"id": "8"}]}))
    x, y = readers.geometry_pages(spark, str(tmp_path / "a.json")).collect()
    assert (x["id_from_source"], x["lng"], str(x["source_captured_at"])[:10]) == ("7", 1.5, "2020-01-01") and (y["lng"], y["lat"]) == (0.0, 0.0)
    (tmp_path / "b.json").write_text(json.dumps({"result": {"data": [{"id": 1, "lng": "3", "lat": 4, "fileurl": "http://x/{{sizeprefix}}/1.jpg", "dateAdded": "2020-01-01"}, {"id": 2, "lng": "bad", "shotDate": None, "dateAdded": "2020-01-01"}]}}))
    x, y = readers.position_pages(spark, str(tmp_path / "b.json")).collect()
    assert x["url"] == "http://x/lth/1.jpg" and x["source_captured_at"] is not None and y["source_captured_at"] is None and y["lng"] is None
    assert readers.canonical_images(readers.position_pages(spark, str(tmp_path / "b.json"))).count() == 1


def test_features_and_polygons(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feats = [{"id": "n1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"power": "pole"}}, {"id": "n2", "geometry": {"type": "Point", "coordinates": [1]}}, {"id": "w1", "geometry": {"type": "Polygon", "coordinates": []}}]
    (tmp_path / "f.json").write_text(json.dumps({"features": feats[:2]}))
    got = readers.feature_pages(spark, str(tmp_path / "f.json")).collect()
    assert [(r["osm_id"], r["osm_type"], r["name"]) for r in got] == [("n1", "power", "pole")]
    shapes = [{"id": "p", "geometry": {"type": "Polygon", "coordinates": [square]}, "properties": {"landuse": "retail"}}, {"id": "m", "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "properties": {"leisure": "park"}}, {"id": "x", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}]
    (tmp_path / "p.json").write_text(json.dumps({"features": shapes}))
    got = readers.polygon_pages(spark, str(tmp_path / "p.json")).collect()
    assert sorted((r["poly_id"], r["part"], len(r["rings"][0])) for r in got) == [("m", 0, 4), ("m", 1, 4), ("p", 0, 4)]


def test_tasks(spark, tmp_path):
    item = lambda i, label: {"id": i, "type": "rectanglelabels", "value": {"x": 10, "y": 10, "width": 20, "height": 20, "rectanglelabels": [label]}}
    tasks = [
        {"id": 1, "data": {"image_id": "a"}, "annotations": [{"result": [item("r1", "bin")]}], "predictions": [{"result": [item("r1", "bin"), item("r2", "pothole")]}]},
        {"id": 2, "data": {"image_id": "b"}, "annotations": json.dumps([{"result": [item("r3", "unknown")]}]), "predictions": []},
        {"id": 3, "data": {"image_id": "c"}, "annotations": [], "predictions": []},
    ]
    (tmp_path / "t.json").write_text(json.dumps({"tasks": tasks}))
    flat = dataset.flattened_tasks(readers.task_pages(spark, str(tmp_path / "t.json")))
    assert {r["image_id"]: [x["id"] for x in r["results"]] for r in flat.collect()} == {"a": ["r1", "r2"], "b": ["r3"]}
    assert sorted((r["id"], r["class_id"]) for r in dataset.task_boxes(flat).collect()) == [("r1", 2), ("r2", 5)]


def test_dataset_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "image_id long, split string")
    writers.dataset_ndjson(rows, str(tmp_path / "d"), {"name": "n"})
    meta, records = readers.dataset_lines(spark, str(tmp_path / "d/*"), "type string, name string, image_id long, split string")
    assert meta.first()["name"] == "n" and {(r["image_id"], r["split"]) for r in records.collect()} == {(1, "train"), (2, "val"), (3, "test")}
    writers.table_csv(spark.createDataFrame([(1, 0.5)], "region_id long, rate double"), str(tmp_path / "c"), {"rate": 6})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["rate"] == "0.500000"
    writers.scores_csv(spark.createDataFrame([(1, 0.5), (2, 0.7)], "region_id long, s double"), str(tmp_path / "s"), "s")
    assert [r["_c0"] for r in spark.read.csv(str(tmp_path / "s")).collect()] == ["2", "1"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img/x.jpg").write_text("no image")
    assert readers.image_sizes(spark, str(tmp_path / "img")).count() == 0


IMAGE = "image_id long, region_id long, id_from_source string, source_captured_at timestamp"


def test_stream_equals_batch(spark, tmp_path):
    landing, target = tmp_path / "landing", tmp_path / "target"
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 2, "b")], "image_id long, region_id long, id_from_source string").withColumn("source_captured_at", F.lit("2020-01-01").cast("timestamp"))
    first.coalesce(1).write.json(str(landing))
    target.mkdir()

    def drain():
        stream = spark.readStream.schema(IMAGE).json(str(landing))
        jobs.append_new(stream, str(target), str(tmp_path / "check")).awaitTermination()
        return sorted(r["id_from_source"] for r in spark.read.schema(IMAGE).option("recursiveFileLookup", True).parquet(str(target)).collect())

    assert drain() == ["a", "b"]
    first.withColumn("id_from_source", F.concat("id_from_source", F.lit("2"))).unionByName(first).coalesce(1).write.mode("append").json(str(landing))
    assert drain() == ["a", "a2", "b", "b2"] and drain() == ["a", "a2", "b", "b2"]


def test_running_counts_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "image_id long, region_id long, id_from_source string").withColumn("source_captured_at", F.lit("2020-01-01").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(IMAGE).parquet(str(tmp_path / "in"))
    q = jobs.running_counts(jobs.arriving_images(stream)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(1, 2), (2, 1)}
    calls = spark.createDataFrame([("k", "2020-01-01 00:00:00"), ("k", "2020-01-01 00:01:00"), ("k", "2020-01-01 00:01:01")], "k string, t string")
    got = jobs.calls_in_trailing_window(calls, "k", F.col("t").cast("timestamp")).orderBy("t").collect()
    assert [r["calls"] for r in got] == [1, 2, 2]  # exactly 60 seconds old still counts


def test_audit_of_a_stream_equals_the_batch(spark, tmp_path):
    """Calls in shuffled order, over several batches and a restart in between, with ties and calls a whole span old."""
    rng = random.Random(5)
    start = 1_577_836_800_000_000
    calls = [(rng.choice("ab"), start + rng.choice([rng.randrange(600_000_000), 10_000_000 * rng.randrange(60)])) for _ in range(400)]
    calls += calls[:5] + [("a", None)]
    want = jobs.calls_in_trailing_window(spark.createDataFrame(calls, "k string, m long").filter("m is not null"), "k", F.timestamp_micros("m")).select("k", "micros", "calls")
    rng.shuffle(calls)
    end = [("end", start + 3_600_000_000)]  # moves the watermark past all others

    def landed(rows, name):
        spark.createDataFrame(rows, "k string, m long").select("k", F.timestamp_micros("m").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def drain():
        stream = spark.readStream.schema("k string, at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = jobs.audited_calls(stream, "k", "at", delay=3000).writeStream.outputMode("append").format("parquet")
        out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    landed(calls[:130], "1")
    landed(calls[130:250], "2")
    drain()
    landed(calls[250:], "3")
    landed(end, "4")
    drain()
    got = spark.read.schema("k string, micros long, calls long").parquet(str(tmp_path / "out")).filter("k <> 'end'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 405


def test_worklist_with_status(spark, tmp_path):
    """A batch that fails between its results and its statuses is repeated whole; nothing stands twice."""
    rows = spark.createDataFrame([(str(k), "unreviewed") for k in range(6)] + [("9", "reviewed")], "image_id string, status string")
    target, log, landing = (str(tmp_path / x) for x in ("target", "log", "in"))
    (tmp_path / "target").mkdir()
    (tmp_path / "log").mkdir()

    def drain(work):
        stream = spark.readStream.schema("image_id string, status string").parquet(landing)
        jobs.drained_worklist(stream, work, target, log, str(tmp_path / "check")).awaitTermination()

    def left():
        return sorted(r["image_id"] for r in jobs.remaining(rows, jobs.batches(spark, log, jobs.STATUS)).collect())

    score = lambda batch: batch.filter("image_id <> '2'").select("image_id", F.lit(0.5).alias("score"))
    rows.filter("image_id < '3'").write.parquet(landing)
    assert left() == list("012345")

    def torn(batch):
        score(batch).write.mode("overwrite").parquet(f"{target}/batch-{0:012d}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(torn)
    assert left() == list("012345")  # results without statuses are still to be done
    drain(score)
    assert left() == list("345")  # the image without results is done too
    rows.filter("image_id between '3' and '4'").write.mode("append").parquet(landing)
    drain(score)
    drain(score)
    assert left() == ["5"]
    assert sorted(r["image_id"] for r in jobs.batches(spark, target, "image_id string, score double").collect()) == list("0134")
    assert {r["image_id"]: r["status"] for r in jobs.folded(rows, jobs.batches(spark, log, jobs.STATUS)).collect()} == {str(k): "unreviewed" if k == 5 else "reviewed" for k in (0, 1, 2, 3, 4, 5, 9)}


def test_image_sizes_equal_the_decoder(spark, tmp_path):
    """Real files of four kinds against Spark's decoding reader; WebP, long JPEG headers and broken files by hand."""
    jvm, folder = spark._jvm, tmp_path / "images"
    folder.mkdir()
    for n, (kind, w, h) in enumerate([("png", 3, 500), ("jpg", 640, 33), ("jpg", 1, 1), ("gif", 300, 7), ("bmp", 17, 259), ("png", 1, 1)]):
        picture = jvm.java.awt.image.BufferedImage(w, h, 1)
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(folder / f"{n}.{kind}")))
    decoded = spark.read.format("image").load(str(folder)).select("image.origin", "image.width", "image.height")
    name = lambda rows: {r[0].rpartition("/")[2]: (r[1], r[2]) for r in rows.collect()}
    want = name(decoded)
    assert len(want) == 6 and want["1.jpg"] == (640, 33) and name(readers.image_sizes(spark, str(folder))) == want
    jpeg = (folder / "1.jpg").read_bytes()
    extra = {
        "long.jpg": (jpeg[:2] + (b"\xff\xe1\xff\xff" + bytes(0xFFFD)) * 3 + b"\xff\xff\xff\xfe\x00\x02" + jpeg[2:], (640, 33)),
        "cut.jpg": (jpeg[:20], None),
        "cut.png": (b"\x89PNG\r\n\x1a\n\x00\x00", None),
        "empty.jpg": (b"", None),
        "text.jpg": (b"no image", None),
        "lossy.webp": (b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00\x00\x00\x00\x9d\x01\x2a" + (800).to_bytes(2, "little") + (0x4000 | 600).to_bytes(2, "little"), (800, 600)),
        "lossless.webp": (b"RIFF\x00\x00\x00\x00WEBPVP8L\x00\x00\x00\x00\x2f" + ((4096 - 1) | (77 - 1) << 14 | 1 << 29).to_bytes(4, "little"), (4096, 77)),
        "extended.webp": (b"RIFF\x00\x00\x00\x00WEBPVP8X\x00\x00\x00\x00\x00\x00\x00\x00" + (69_999).to_bytes(3, "little") + (1).to_bytes(3, "little"), (70_000, 2)),
    }
    for file, (data, _) in extra.items():
        (folder / file).write_bytes(data)
    assert name(readers.image_sizes(spark, str(folder))) == want | {k: v for k, (_, v) in extra.items() if v}
