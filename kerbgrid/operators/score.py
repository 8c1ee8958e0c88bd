"""Counts and scores by region. Each score is one pass and one shuffle by region_id per input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.functions.lookups import FEATURE_SEVERITY, FEATURE_WEIGHT, MIN_FEATURES, MIN_IMAGES, SEVERITY, weight


def images_per_region(images: DataFrame) -> DataFrame:
    return images.groupBy("region_id").agg(F.count("*").alias("images"))


def detections_with_region(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections inner-joined to their image's region."""
    return detections.join(images.select("image_id", "region_id"), "image_id")


def detections_per_region(images: DataFrame, detections: DataFrame) -> DataFrame:
    return detections_with_region(images, detections).groupBy("region_id").agg(F.count("*").alias("detections"))


def labels_per_region(images: DataFrame, detections: DataFrame, listed: dict[str, float] = SEVERITY) -> DataFrame:
    rows = detections.filter(F.col("label").isin(*listed))
    return detections_with_region(images, rows).groupBy("region_id", "label").agg(F.count("*").alias("n"))


def features_per_region(features: DataFrame) -> DataFrame:
    return features.groupBy("region_id").agg(F.count("*").alias("features"))


def types_per_region(features: DataFrame, listed: dict[str, float] = FEATURE_SEVERITY) -> DataFrame:
    return features.filter(F.col("osm_type").isin(*listed)).groupBy("region_id", "osm_type").agg(F.count("*").alias("n"))


def _index(kind: str, weights: dict[str, float]) -> Column:
    """Share of listed kinds present times the mean weight over all rows. Unlisted kinds count in the
    mean's denominator; listed kinds of weight 0 count as present."""
    w = weight(F.col(kind), weights)
    present = F.countDistinct(F.when(w.isNotNull(), F.col(kind))) / len(weights)
    score = present * F.coalesce(F.sum(w), F.lit(0.0)) / F.count("*")
    return F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def detection_index(images: DataFrame, detections: DataFrame, min_images: int | None = MIN_IMAGES) -> DataFrame:
    """region_id, vpi for each region with images; 0 under min_images images (None: no threshold) and
    for regions without detections."""
    own = detections_with_region(images, detections).groupBy("region_id").agg(_index("label", SEVERITY).alias("index"))
    enough = F.lit(True) if min_images is None else F.col("images") >= min_images
    return images_per_region(images).join(own, "region_id", "left").select("region_id", F.when(enough, F.coalesce("index", F.lit(0.0))).otherwise(0.0).alias("vpi"))


def feature_index(features: DataFrame) -> DataFrame:
    return features.groupBy("region_id").agg(_index("osm_type", FEATURE_SEVERITY).alias("feature_index"))


def blended_index(images: DataFrame, detections: DataFrame, features: DataFrame, share: float = FEATURE_WEIGHT, min_images: int | None = MIN_IMAGES, min_features: int | None = MIN_FEATURES) -> DataFrame:
    """region_id, vpi_osm over all regions with images or features: the detection and feature indexes
    blended; 0 under either threshold, and the detection index alone where there are no features."""
    share = min(max(share, 0.0), 1.0)
    counts = images_per_region(images).join(features_per_region(features), "region_id", "full")
    n_images, n_features = F.coalesce("images", F.lit(0)), F.coalesce("features", F.lit(0))
    rows = counts.join(detection_index(images, detections, None), "region_id", "left").join(feature_index(features), "region_id", "left")
    low = F.lit(False)
    if min_images is not None:
        low = low | (n_images < min_images)
    if min_features is not None:
        low = low | (n_features < min_features)
    own = F.coalesce("vpi", F.lit(0.0))
    blend = (1 - share) * own + share * F.coalesce("feature_index", F.lit(0.0))
    return rows.select("region_id", F.when(low, 0.0).when(n_features == 0, own).otherwise(blend).alias("vpi_osm"))


def score_region(images: DataFrame, detections: DataFrame, features: DataFrame, region_id, method: str = "vpi", **thresholds) -> DataFrame:
    """region_id, score of one region by method vpi or vpi_osm; another method scores 0."""
    here = F.col("region_id") == region_id
    images, features = images.filter(here), features.filter(here)
    if method == "vpi":
        return detection_index(images, detections, **thresholds).withColumnRenamed("vpi", "score")
    if method == "vpi_osm":
        return blended_index(images, detections, features, **thresholds).withColumnRenamed("vpi_osm", "score")
    return images.select("region_id").distinct().withColumn("score", F.lit(0.0))


def with_scores(regions: DataFrame, scores: DataFrame, column: str = "vpi") -> DataFrame:
    """regions with their score replaced; regions without one score 0."""
    found = scores.select("region_id", F.col(column).alias("new_score"))
    return regions.drop("score").join(found, "region_id", "left").withColumn("score", F.coalesce("new_score", F.lit(0.0))).drop("new_score")
