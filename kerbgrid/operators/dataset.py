"""Training-dataset products: samples, boxes, tasks, splits and shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbgrid.functions.boxes import box_numbers, box_of_numbers, centre_box, percent_rectangle, percent_to_centre
from kerbgrid.functions.lookups import CLASSES, class_id
from kerbgrid.scratch import ahead, running, written

TRAIN, VAL = 0.7, 0.2


def seeded(seed: int, key: str = "image_id") -> Column:
    """The key of a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def sample_per_country(images: DataFrame, regions: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """n images of each country by a seeded hash of their id: the same rows in each run and engine."""
    rows = images.join(regions.select("region_id", "country"), "region_id")
    order = Window.partitionBy("country").orderBy(seeded(seed), "image_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def sample_of_region(images: DataFrame, region_id, k: int, seed: int = 0) -> DataFrame:
    return images.filter(F.col("region_id") == region_id).orderBy(seeded(seed), "image_id").limit(k)


def with_parsed(detections: DataFrame) -> DataFrame:
    """detections with their readable box as corners (null: unreadable). Generators keep the parsing
    from being copied into each expression and filter that reads it."""
    rows = detections.select("*", F.explode(F.array(box_numbers(F.col("bbox")))).alias("_numbers"))
    return rows.select(*detections.columns, F.explode(F.array(box_of_numbers(F.col("_numbers"), F.col("bbox")))).alias("corners"))


def centre_boxes(images: DataFrame, detections: DataFrame) -> DataFrame:
    """image_id, detection_id and class_id, xc, yc, w, h of each usable box."""
    rows = with_parsed(detections).join(images.select("image_id", "width", "height"), "image_id")
    box = centre_box(F.col("corners"), F.col("width"), F.col("height"), F.col("label"))
    return rows.select("image_id", "detection_id", box.alias("box")).filter("box is not null").select("image_id", "detection_id", "box.*")


def export_records(images: DataFrame, regions: DataFrame, detections: DataFrame) -> DataFrame:
    """One nested record an image: its fields, those of its region, boxes (usable ones) and predictions
    (label, class_id, confidence, bbox; detections with an unreadable box are dropped)."""
    read = with_parsed(detections).filter("corners IS NOT NULL").join(images.select("image_id", "width", "height"), "image_id")
    pred = F.struct("detection_id", "label", class_id(F.col("label")).alias("class_id"), "confidence", F.col("corners").alias("bbox"))
    box = F.struct("detection_id", "class_id", "xc", "yc", "w", "h")
    read = read.withColumn("box", F.explode(F.array(centre_box(F.col("corners"), F.col("width"), F.col("height"), F.col("label"))))).select("image_id", "detection_id", pred.alias("pred"), "box.*")
    both = read.groupBy("image_id").agg(F.array_sort(F.collect_list("pred")).alias("predictions"), F.array_sort(F.collect_list(F.when(F.col("class_id").isNotNull(), box))).alias("boxes"))
    name = F.col("name") if "name" in regions.columns else F.lit(None).cast("string")
    region = regions.select("region_id", name.alias("region_name"), "city", "country")
    rows = images.join(region, "region_id", "left").join(both, "image_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    return rows.select(F.lit("image").alias("type"), "image_id", "url", "width", "height", "region_id", "region_name", "city", "country", "lng", "lat", none("boxes"), none("predictions"))


def annotated_records(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One nested record for each image with annotated boxes (image_id, id, class_id, xc, yc, w, h), by an
    inner join: boxes of images that are not stored are left out."""
    some = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "class_id", "xc", "yc", "w", "h"))).alias("boxes"))
    return images.select("image_id", "url", "width", "height").join(some, "image_id").select(F.lit("image").alias("type"), "*")


#: The descriptor of an exported dataset.
DESCRIPTOR = {"type": "dataset", "task": "detect", "name": "VP Detection", "description": "Dataset containing images of visual pollution"}
FORMAT = {"storage": "tar-shards", "index": "ndjson"}


def dataset_descriptor(spark, shard_size: int, index: str, shards: str) -> DataFrame:
    """One row that describes an exported dataset: what it is, its classes by id, format and paths."""
    lit = lambda values: [F.lit(v).alias(k) for k, v in values.items()]
    format_ = F.struct(*lit(FORMAT), F.lit(True).alias("preserves_original_bytes"), F.lit(shard_size).alias("shard_size"))
    names = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (str(i), c)])
    return spark.range(1).select(*lit(DESCRIPTOR), names.alias("class_names"), format_.alias("format"), F.struct(F.lit(index).alias("index"), F.lit(shards).alias("shards")).alias("paths"))


def tasks(images: DataFrame, detections: DataFrame, batch: int = 1000, keep_empty: bool = False, model_version: str | None = None) -> DataFrame:
    """Annotation tasks: image_id, score (largest confidence), results (percent rectangles by
    confidence), JSON payload and batch number by image order. With keep_empty images without
    detections are tasks too, without predictions."""
    rect = percent_rectangle(F.col("corners"), F.col("width"), F.col("height"), F.col("label"))
    rows = with_parsed(detections).join(images.select("image_id", "width", "height"), "image_id")
    item = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "label", "detection_id", rect.alias("rect"))
    found = rows.groupBy("image_id").agg(F.max("confidence").alias("score"), F.array_sort(F.collect_list(item)).alias("items"))
    found = images.select("image_id", "url").join(found, "image_id", "left" if keep_empty else "inner").withColumn("results", F.transform("items", lambda x: x["rect"]))
    prediction = F.struct(F.lit(model_version).cast("string").alias("model_version"), "score", F.col("results").alias("result"))
    payload = F.to_json(F.struct(F.struct(F.col("url").alias("image"), "image_id").alias("data"), F.when(F.col("results").isNotNull(), F.array(prediction)).alias("predictions")))
    return with_index(found.select("image_id", "score", "results", payload.alias("payload")), "image_id").withColumn("batch", F.floor(F.col("index") / batch)).drop("index")


def flattened_tasks(rows: DataFrame) -> DataFrame:
    """Tasks (task_id, image_id, annotations array<struct<id,label,x,y,width,height>>, predictions of the
    same) as one result list: annotations, then predictions whose id is among no annotation of the task;
    tasks without results are dropped."""
    known = F.transform("annotations", lambda a: a["id"])
    rest = F.filter("predictions", lambda p: ~F.coalesce(F.array_contains(known, p["id"]), F.lit(False)))
    return rows.select("task_id", "image_id", F.concat(F.coalesce("annotations", F.array().cast(rows.schema["annotations"].dataType)), F.coalesce(rest, F.array().cast(rows.schema["annotations"].dataType))).alias("results")).filter(F.size("results") > 0)


def task_boxes(flat: DataFrame) -> DataFrame:
    """image_id and class_id, xc, yc, w, h of each usable result of flattened tasks."""
    rows = flat.select("image_id", F.explode("results").alias("r"))
    box = percent_to_centre(F.col("r.label"), F.col("r.x"), F.col("r.y"), F.col("r.width"), F.col("r.height"))
    return rows.select("image_id", F.col("r.id").alias("id"), box.alias("box")).filter("box is not null").select("image_id", "id", "box.*")


def with_index(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with a global index from 0 in the given total order: sorted by range, numbered within
    partitions, and shifted by the partitions' counts; no partition holds all rows. Rows are written
    once, as both steps must see the same partitions."""
    placed = written(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "indexed")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_place").alias("_low")).withColumn("_start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("_part", "_low", "_start")
    return placed.join(F.broadcast(starts), "_part").withColumn("index", F.col("_start") + F.col("_place") - F.col("_low")).drop("_part", "_place", "_low", "_start")


def shard_index(records: DataFrame, size: int = 10_000, key: str = "image_id") -> DataFrame:
    """records with shard, member name and shard file of each, consecutive in the order of key."""
    if size < 1:
        raise ValueError("shards hold a sample at least")
    rows = with_index(records, key)
    shard = F.floor(F.col("index") / size)
    return rows.withColumn("shard", F.format_string("shard-%06d.tar", shard)).withColumn("member", F.format_string("%08d", "index"))


def balanced_split(rows: DataFrame, boxes: DataFrame, seed: int = 0, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """image_id, split. Totals are exactly int(n * train), int(n * val) and the rest; images are
    stratified by the rarest class among their boxes (unlabelled ones apart) in hashed order, so each
    class is spread in proportion. Single images need not fall as a sequential draw would have it."""
    freq = boxes.groupBy("class_id").agg(F.count("*").alias("n"))
    rarest = boxes.join(F.broadcast(freq), "class_id").groupBy("image_id").agg(F.min(F.struct("n", "class_id"))["class_id"].alias("stratum"))
    rows = with_index(rows.select("image_id").join(rarest, "image_id", "left").withColumn("h", seeded(seed)), F.coalesce("stratum", F.lit(-1)), "h", "image_id")
    n = rows.count()
    a, b = int(n * train), int(n * val)
    m = max(n - a, 1)
    hit = lambda i, part, of: F.floor((i + 1) * part / of) > F.floor(i * part / of)
    i = F.col("index")
    j = i - F.floor(i * a / max(n, 1))
    return rows.select("image_id", "stratum", F.when(hit(i, a, max(n, 1)), "train").when(hit(j, b, m), "val").otherwise("test").alias("split"))


def deficit_split(rows: DataFrame, boxes: DataFrame, seed: int = 0, train: float = TRAIN, val: float = VAL) -> DataFrame:
    """image_id, split: a draw by open deficits of classes, in rounds from the rarest class on. Totals are exactly
    int(n * train), int(n * val) and the rest.

    An image belongs to the round of its rarest class, where images with most boxes of it come first, then in
    hashed order. A round shares its boxes among splits by what each still lacks of the class (its share of
    all boxes less what earlier rounds brought): a ranked cumulative sum says where the next split begins, to
    the nearest box. What goes beyond a split's size, and images without boxes, fill the splits up at the
    end in hashed order. Ranks and sums are one pass over all images dealt by ranges; a round is one small
    aggregate, and only its totals, a number for each split and class, come to the driver."""
    c, share = F.col, {"train": train, "val": val, "test": 1 - train - val}
    freq = boxes.join(rows.select("image_id"), "image_id", "left_semi").groupBy("class_id").agg(F.count("*").alias("n")).orderBy("n", "class_id").collect()
    classes, total = [r["class_id"] for r in freq], {r["class_id"]: r["n"] for r in freq}
    held = boxes.groupBy("image_id").agg(F.count("*").alias("any"), *[F.count_if(c("class_id") == k).alias(f"n{k}") for k in classes])
    base = rows.select("image_id").join(held, "image_id", "left").fillna(0)
    first = lambda pick, none: F.coalesce(*[F.when(c(f"n{k}") > 0, pick(k)) for k in classes], none)
    base = base.select("image_id", first(F.lit, F.lit(-1)).cast("long").alias("stratum"), first(lambda k: c(f"n{k}"), F.lit(0)).alias("own"), *[f"n{k}" for k in classes], seeded(seed).alias("h"))
    ranked, pieces = running(base, ["stratum"], [c("own").desc(), c("h"), c("image_id")], "ranked", 1, lambda columns, places: columns["own"][:, None])
    ranked = written(ahead(ranked, pieces, 1), "strata")
    n = ranked.count()
    room = {"train": int(n * train), "val": int(n * val)}
    room["test"] = n - room["train"] - room["val"]
    got, cuts = {s: dict.fromkeys(classes, 0) for s in share}, {}
    for k in classes:
        lack = {s: max(total[k] * share[s] - got[s][k], 0.0) for s in share}
        mine = ranked.filter(c("stratum") == k)
        # Where each split ends, in boxes counted to the middle of an image; then, in images, where its room does.
        size = mine.agg(F.max("s0").alias("n")).first()["n"] or 0
        one = size * lack["train"] / (sum(lack.values()) or 1.0)
        two = size * (lack["train"] + lack["val"]) / (sum(lack.values()) or 1.0)
        middle = c("s0") - c("own") / 2
        ends = mine.agg(F.count_if(middle <= one).alias("a"), F.count_if(middle <= two).alias("b"), F.count("*").alias("c")).first()
        a, b, whole = ends["a"], ends["b"], ends["c"]
        cuts[k] = {"train": (0, min(a, room["train"])), "val": (a, a + min(b - a, room["val"])), "test": (b, b + min(whole - b, room["test"]))}
        for s, (low, high) in cuts[k].items():
            room[s] -= high - low
        named = mine.withColumn("split", _named(cuts[k])).filter("split IS NOT NULL")
        for r in named.groupBy("split").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in classes]).collect():
            for j in classes:
                got[r["split"]][j] += r[f"n{j}"]
    split = F.lit(None).cast("string")
    for k in classes:
        split = F.when(c("stratum") == k, _named(cuts[k])).otherwise(split)
    ranked = ranked.select("image_id", "h", split.alias("split"))
    rest, pieces = running(ranked.filter("split IS NULL").select("image_id", "h"), [], ["h", "image_id"], "rest", 0, lambda columns, places: np.zeros((len(places), 0), np.int64))
    a, b = room["train"], room["train"] + room["val"]
    rest = ahead(rest, pieces, 0).select("image_id", F.when(c("place") <= a, "train").when(c("place") <= b, "val").otherwise("test").alias("split"))
    return ranked.filter("split IS NOT NULL").select("image_id", "split").unionByName(rest)


def _named(cuts: dict[str, tuple[int, int]]) -> Column:
    """The split whose places (low excluded, high included) hold a row's."""
    out = F.lit(None).cast("string")
    for s, (low, high) in cuts.items():
        out = F.when((F.col("place") > low) & (F.col("place") <= high), s).otherwise(out)
    return out


def class_counts(split: DataFrame, boxes: DataFrame) -> DataFrame:
    """split, class_id, n over the boxes of each split."""
    return boxes.join(split.select("image_id", "split"), "image_id").groupBy("split", "class_id").agg(F.count("*").alias("n"))


def chunk_number(index: Column, n: int, k: int) -> Column:
    """Chunk of a row when n rows are cut into k consecutive chunks of equal size, rounded up."""
    return F.floor(index / max(1, -(-n // k)))
