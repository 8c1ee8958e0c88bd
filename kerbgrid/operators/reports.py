"""Rankings, coverage, layers and land-use densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbgrid.functions.lookups import BINS, LAND_USES, MIN_IMAGES, MIXED_USE, SEVERITY, UNMATCHED, count_bin, weight
from kerbgrid.functions.text import clean_label, norm, ratio
from kerbgrid.operators.score import detections_with_region, images_per_region


def top_regions_per_label(regions: DataFrame, images: DataFrame, detections: DataFrame, top: int = 10, min_images: int = MIN_IMAGES) -> DataFrame:
    """The regions with the most detections per image of each label, among those without a capture
    window and with min_images images."""
    free = regions.filter(F.col("start_captured_at").isNull() & F.col("end_captured_at").isNull())
    counted = images_per_region(images).filter(F.col("images") >= min_images)
    found = detections_with_region(images, detections.filter(F.trim("label") != "")).groupBy("region_id", F.trim("label").alias("label")).agg(F.count("*").alias("detections"))
    rows = found.join(counted, "region_id").join(free.select("region_id", "city", "country", "dense_scan"), "region_id").withColumn("rate", F.col("detections") / F.col("images"))
    order = Window.partitionBy("label").orderBy(F.desc("rate"), F.desc("detections"), F.desc("images"), norm(F.col("country")), norm(F.col("city")), "region_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("label", "rank", "region_id", "city", "country", "images", "detections", "rate", "dense_scan")


def top_and_bottom(scores: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n highest and the n lowest positive scores: side, region_id, score."""
    some = scores.filter(F.col(column) > 0).select("region_id", F.col(column).alias("score"))
    top = some.orderBy(F.desc("score"), "region_id").limit(n).select(F.lit("top").alias("side"), "region_id", "score")
    return top.unionByName(some.orderBy("score", "region_id").limit(n).select(F.lit("bottom").alias("side"), "region_id", "score"))


def billboard_ratio(wanted: DataFrame, regions: DataFrame, images: DataFrame, detections: DataFrame) -> DataFrame:
    """For each wanted region_id billboards, detections and images, and billboards an image; unknown
    ids stay, as NOT_FOUND."""
    per_image = images_per_region(images)
    per_label = detections_with_region(images, detections).groupBy("region_id").agg(F.count_if(norm(F.col("label")) == "billboard").alias("billboards"), F.count("*").alias("detections"))
    known = regions.select("region_id", "city", "country", F.lit(True).alias("known"))
    rows = wanted.join(known, "region_id", "left").join(per_image, "region_id", "left").join(per_label, "region_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    named = lambda c: F.when(F.col("known"), F.coalesce(c, F.lit(""))).otherwise("NOT_FOUND").alias(c)
    return rows.select("region_id", named("city"), named("country"), zero("images").alias("images"), zero("billboards").alias("billboards"), zero("detections").alias("detections"), ratio(zero("billboards"), zero("images")).alias("per_image"))


def cities_over(regions: DataFrame, counts: DataFrame, least: int, by: str = "country", bins: tuple = BINS) -> DataFrame:
    """country (or iso3, by that), cities, bin: per country the cities whose rows of counts (region_id, n)
    sum to least or more; countries without such cities have 0, regions without the key are left out."""
    known = regions.filter(F.col(by).isNotNull())
    per_city = counts.join(known.select("region_id", by, "city"), "region_id").groupBy(by, "city").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    per_country = per_city.groupBy(by).agg(F.count("*").alias("cities"))
    found = known.select(by).distinct().join(per_country, by, "left").select(by, F.coalesce("cities", F.lit(0)).cast("long").alias("cities"))
    return found.withColumn("bin", count_bin(F.col("cities"), bins))


def distinct_cities(regions: DataFrame, by: str = "country", bins: tuple = BINS) -> DataFrame:
    """country (or iso3, by that), cities, bin over regions whose population and key are known."""
    found = regions.filter(F.col("population").isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.countDistinct("city").alias("cities"))
    return found.withColumn("bin", count_bin(F.col("cities"), bins))


def midpoints(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", ((F.col("min_lng") + F.col("max_lng")) / 2).alias("lng"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"))


def log_normalised(regions: DataFrame, counts: DataFrame, low: float = 2.0, high: float = 12.0) -> DataFrame:
    """region_id, n, share, radius, lng, lat over regions that are not dense: log1p of the count over
    log1p of the largest count among them, and a radius between low and high."""
    some = counts.join(regions.filter(~F.col("dense_scan")).select("region_id"), "region_id", "left_semi")
    most = some.agg(F.max("n").alias("most"))
    share = F.coalesce(F.try_divide(F.log1p("n"), F.log1p("most")), F.lit(0.0))
    rows = some.crossJoin(F.broadcast(most)).withColumn("share", share)
    return rows.join(midpoints(regions), "region_id").select("region_id", "n", "share", (low + F.col("share") * (high - low)).alias("radius"), "lng", "lat")


def min_max_normalised(scores: DataFrame, column: str) -> DataFrame:
    """region_id, score, share of the range of positive scores (1 where all are equal)."""
    some = scores.filter(F.col(column) > 0).select("region_id", F.col(column).alias("score"))
    ends = some.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return some.crossJoin(F.broadcast(ends)).select("region_id", "score", share.alias("share"))


def best_detection(detections: DataFrame) -> DataFrame:
    """image_id, n, best label and confidence; ties by label, then detection_id; null confidence last."""
    order = F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "label", "detection_id", "confidence"))
    return detections.groupBy("image_id").agg(F.count("*").alias("n"), order.alias("best")).select("image_id", "n", F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"))


def detection_layer(images: DataFrame, detections: DataFrame) -> DataFrame:
    """One marker an image: position, number, best label, text of its detections by confidence."""
    key = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "label", "detection_id", "confidence")
    found = detections.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["label"], F.lit(" "), F.coalesce(F.round(x["confidence"] * 100).cast("int").cast("string"), F.lit("?")))), "; ")
    rows = images.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).join(found, "image_id")
    return rows.select("image_id", "lng", "lat", "n", F.col("all")[0]["label"].alias("label"), text.alias("tooltip"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def image_layer(images: DataFrame) -> DataFrame:
    return images.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select("image_id", "lng", "lat", "source")


def heat_points(images: DataFrame, detections: DataFrame, metric: str = "severity") -> DataFrame:
    """image_id, lat, lng, weight of each detection: its severity or 1; weights of 0 are dropped."""
    worth = F.coalesce(weight(F.col("label"), SEVERITY), F.lit(0.0)) if metric == "severity" else F.lit(1.0)
    placed = images.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select("image_id", "lng", "lat")
    return detections.join(placed, "image_id").select("image_id", "lat", "lng", worth.alias("weight")).filter(F.col("weight") > 0)


def combined_box(regions: DataFrame) -> DataFrame:
    """The box around all regions, and its centre."""
    box = regions.agg(F.min("min_lng").alias("min_lng"), F.min("min_lat").alias("min_lat"), F.max("max_lng").alias("max_lng"), F.max("max_lat").alias("max_lat"))
    return box.withColumn("lng", (F.col("min_lng") + F.col("max_lng")) / 2).withColumn("lat", (F.col("min_lat") + F.col("max_lat")) / 2)


def midpoint_extent(regions: DataFrame) -> DataFrame:
    return midpoints(regions).agg(F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"))


def land_use_density(assigned: DataFrame, detections: DataFrame, include_mixed: bool = False, include_unmatched: bool = False) -> DataFrame:
    """label, land_use, images, detections, density: detections an image for every label and land use,
    zero-filled; null density where a land use has no images. assigned: image_id, land_use."""
    uses = [*LAND_USES, *([MIXED_USE] if include_mixed else []), *([UNMATCHED] if include_unmatched else [])]
    grid = detections.sparkSession.createDataFrame([(u, i) for i, u in enumerate(uses)], "land_use string, place int")
    shown = assigned.filter(F.col("land_use").isin(uses))
    per_use = shown.groupBy("land_use").agg(F.count("*").alias("images"))
    labelled = detections.select("image_id", clean_label(F.col("label")).alias("label"))
    per_pair = labelled.join(shown, "image_id").groupBy("label", "land_use").agg(F.count("*").alias("detections"))
    rows = per_pair.select("label").distinct().crossJoin(F.broadcast(grid)).join(per_use, "land_use", "left").join(per_pair, ["label", "land_use"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("label", "land_use", "place", n("images").alias("images"), n("detections").alias("detections"), F.try_divide(n("detections"), n("images")).alias("density"))


def land_use_rollup(density: DataFrame) -> DataFrame:
    """The grid summed over labels: land_use, images, detections, density."""
    rows = density.groupBy("land_use").agg(F.max("images").alias("images"), F.sum("detections").alias("detections"))
    return rows.withColumn("density", F.try_divide("detections", "images"))


def density_range(density: DataFrame) -> DataFrame:
    """label, low, high of known densities; equal ends are widened by 1e-9."""
    ends = density.groupBy("label").agg(F.min("density").alias("low"), F.max("density").alias("high"))
    return ends.withColumn("high", F.when(F.col("high") == F.col("low"), F.col("high") + 1e-9).otherwise(F.col("high")))


def density_series(density: DataFrame) -> DataFrame:
    """The grid in the fixed order of land uses, missing densities 0: for charts."""
    return density.select("label", "place", "land_use", F.coalesce("density", F.lit(0.0)).alias("density"))


def interpolated_colour(share: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Hex colour between two, at a share of 0 to 1."""
    part = lambda a, b: F.lpad(F.hex(F.round(a + share * (b - a)).cast("long")), 2, "0")
    return F.concat(F.lit("#"), *[part(a, b) for a, b in zip(low, high)])
