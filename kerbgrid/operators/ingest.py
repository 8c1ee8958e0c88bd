"""Idempotent appends, patches, deletes and worklists: each is a plan from old tables to new ones, which
the caller writes; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(target: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of batch to append: the first of each key (by order) that target doesn't hold. Rows with
    a null key are all new, as unique indexes have it."""
    keyed = batch.filter(F.col(key).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_place = 1").drop("_place")
    return keyed.join(target.select(key), key, "left_anti").select(*batch.columns).unionByName(batch.filter(F.col(key).isNull()))


def upsert_images(images: DataFrame, batch: DataFrame) -> DataFrame:
    """images and the new ones of batch, whose status defaults to unreviewed."""
    fresh = new_rows(images, batch, "id_from_source", "image_id").withColumn("status", F.coalesce("status", F.lit("unreviewed")))
    return images.unionByName(fresh, allowMissingColumns=True)


def upsert_detections(detections: DataFrame, batch: DataFrame) -> DataFrame:
    fresh = new_rows(detections, batch, "detection_id", "label").withColumn("manual_reviewed", F.coalesce("manual_reviewed", F.lit(0)))
    return detections.unionByName(fresh, allowMissingColumns=True)


def append_features(features: DataFrame, batch: DataFrame, distinct: bool = False) -> DataFrame:
    """A plain append; with distinct only the features that their region doesn't hold by osm_id."""
    if distinct:
        batch = batch.dropDuplicates(["region_id", "osm_id"]).join(features.select("region_id", "osm_id"), ["region_id", "osm_id"], "left_anti").select(*batch.columns)
    return features.unionByName(batch, allowMissingColumns=True)


def patch(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the non-null values of changes (one row a key) in its other columns."""
    own = [c for c in changes.columns if c != key]
    found = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    rows = target.join(found, key, "left")
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in target.columns])


def set_status(images: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return patch(images, ids.select("image_id").distinct().withColumn("status", F.lit(status)), "image_id")


def reset_detections(images: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with reviewed ones unreviewed again, and no detections."""
    return images.withColumn("status", F.when(F.col("status") == "reviewed", "unreviewed").otherwise(F.col("status"))), detections.limit(0)


def delete_regions(ids: DataFrame, regions: DataFrame, images: DataFrame, detections: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table, and the deleted regions."""
    ids = ids.select("region_id").distinct()
    gone = images.join(ids, "region_id", "left_semi").select("image_id")
    return {
        "deleted": regions.join(ids, "region_id", "left_semi"),
        "regions": regions.join(ids, "region_id", "left_anti"),
        "images": images.join(ids, "region_id", "left_anti"),
        "features": features.join(ids, "region_id", "left_anti"),
        "detections": detections.join(gone, "image_id", "left_anti"),
    }


def stale_urls(images: DataFrame, source: str, cutoff: Column, limit: int | None = None, force: bool = False) -> DataFrame:
    """Images of a source whose URL was never fetched or before cutoff, the longest waiting first."""
    rows = images.filter((F.col("source") == source) & F.col("id_from_source").isNotNull())
    if not force:
        rows = rows.filter(F.col("url_fetched_at").isNull() | (F.col("url_fetched_at") < cutoff))
    rows = rows.orderBy(F.asc_nulls_first("url_fetched_at"), "image_id")
    return rows if limit is None else rows.limit(limit)


def refreshed_urls(images: DataFrame, found: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """images with the URLs of found (image_id, url, error) and their fetch time; and the number of each
    outcome: processed, refreshed, skipped (blank URL), failed (error)."""
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.trim(F.coalesce("url", F.lit(""))) == "", "skipped").otherwise("refreshed")
    rows = found.withColumn("outcome", outcome)
    changes = rows.filter("outcome = 'refreshed'").select("image_id", "url", at.alias("url_fetched_at"))
    tally = rows.agg(F.count("*").alias("processed"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("refreshed", "skipped", "failed")])
    return patch(images, changes, "image_id"), tally


def admitted_regions(regions: DataFrame, batch: DataFrame, override: bool = False) -> DataFrame:
    """regions and those of batch whose name is new; with override those of batch replace old ones."""
    if override:
        return regions.join(batch.select("name"), "name", "left_anti").select(*regions.columns).unionByName(batch, allowMissingColumns=True)
    return regions.unionByName(new_rows(regions, batch, "name", "region_id"), allowMissingColumns=True)


def overridden(regions: DataFrame, batch: DataFrame, images: DataFrame, detections: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """Admission with override: regions of batch replace those of their name, and with these go their
    images, the images' detections and their features. The tables by name, as in delete_regions."""
    left = delete_regions(regions.join(batch.select("name").distinct(), "name", "left_semi"), regions, images, detections, features)
    return left | {"regions": left["regions"].unionByName(batch, allowMissingColumns=True)}


def features_of(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features of the wanted regions and types: (region_id, osm_type), a null type stands for all."""
    any_ = wanted.filter("osm_type is null").select("region_id").distinct()
    some = wanted.filter("osm_type is not null").select("region_id", "osm_type").distinct()
    return features.join(any_, "region_id", "left_semi").unionByName(features.join(any_, "region_id", "left_anti").join(some, ["region_id", "osm_type"], "left_semi"))


#: Sources that dense scans leave out.
NOT_DENSE = ("kartaview",)


def eligible_sources(regions: DataFrame, sources: list[str]) -> DataFrame:
    """region_id, source: the sources to ask for each region; dense scans leave some out."""
    rows = regions.select("region_id", "dense_scan", F.explode(F.array(*map(F.lit, sources))).alias("source"))
    return rows.filter(~(F.coalesce("dense_scan", F.lit(False)) & F.col("source").isin(*NOT_DENSE))).select("region_id", "source")


def with_detections(images: DataFrame, detections: DataFrame, region_id=None, status: str | None = None) -> DataFrame:
    """Images with a detection at least, of a region and status if given."""
    if region_id is not None:
        images = images.filter(F.col("region_id") == region_id)
    if status is not None:
        images = images.filter(F.col("status") == status)
    return images.join(detections.select("image_id"), "image_id", "left_semi")


def unreviewed_detections(images: DataFrame, detections: DataFrame, region_id=None) -> DataFrame:
    rows = detections.filter("manual_reviewed = 0")
    return rows if region_id is None else rows.join(images.filter(F.col("region_id") == region_id).select("image_id"), "image_id", "left_semi")


def regions_by_city(regions: DataFrame, city: str | None = None, country: str | None = None) -> DataFrame:
    """Regions by city, country or both, trimmed and in any case, ordered by country, city and id; none where neither
    is given."""
    from kerbgrid.functions.text import caseless

    rows = regions if city or country else regions.limit(0)
    for column, value in (("city", city), ("country", country)):
        if value:
            rows = rows.filter(caseless(F.col(column)) == caseless(F.lit(value)))
    return rows.orderBy(caseless(F.col("country")), caseless(F.col("city")), "region_id")


def resolved_regions(spark, regions: DataFrame, tokens: list[str], cities: list[str]) -> DataFrame:
    """region_id, place: ids of comma-separated tokens in order, then regions of the cities; the first
    occurrence of an id counts, unknown ids are left out."""
    from kerbgrid.functions.text import norm

    given = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "a int, token string")
    ids = given.select("a", F.posexplode(F.split("token", ",")).alias("b", "id")).select((F.col("a") * 100000 + F.col("b")).cast("long").alias("place"), F.trim("id").alias("id")).filter("id <> ''")
    named = regions.filter(norm(F.col("city")).isin([c.strip().lower() for c in cities]))
    by_city = named.withColumn("place", 10**12 + F.row_number().over(Window.orderBy(norm(F.col("country")), norm(F.col("city")), "region_id"))).select("place", F.col("region_id").cast("string").alias("id"))
    first = ids.unionByName(by_city).groupBy("id").agg(F.min("place").alias("place"))
    return regions.join(first, regions["region_id"].cast("string") == first["id"]).select("region_id", "place")
