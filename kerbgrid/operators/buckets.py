"""Mutations that rewrite only what they touch: tables in folders by hash of their region.

A table at a path has its rows in folders bucket=0 to bucket=BUCKETS - 1, by hash of region_id. A change reads the
buckets that its rows name (partition filters prune the scan), keeps those in which a value would differ, and
overwrites these folders alone; Spark moves a folder's new files into place once all are written. What is
to change is told by content: the same change again finds nothing that differs and writes nothing, and one
that a failure cut short finishes the buckets that still differ. Appends add files and read just the buckets
of the batch. Rows of one region stay together in no file: writers deal a bucket's rows by hash of all
columns, so that a hot region's rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbgrid.operators.ingest import new_rows, patch
from kerbgrid.scratch import deleted, dropped, written

BUCKETS = 64


def bucket_of(region: Column) -> Column:
    return F.pmod(F.xxhash64(region), F.lit(BUCKETS)).cast("int")


def _laid_out(rows: DataFrame, files: int) -> DataFrame:
    """rows with their bucket, dealt to files tasks a bucket at most."""
    spread = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns]), F.lit(files))
    return rows.withColumn("bucket", bucket_of(F.col("region_id"))).repartition(F.col("bucket"), spread)


def create(rows: DataFrame, path: str, files: int = 4) -> None:
    _laid_out(rows, files).write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table, or those of its buckets."""
    table = spark.read.parquet(path)
    return table if only is None else table.filter(F.col("bucket").isin(only))


def _buckets(rows: DataFrame) -> list[int]:
    """At most BUCKETS numbers."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def _overwritten(path: str, old: DataFrame, new: DataFrame, touched: list[int], files: int) -> list[int]:
    """Puts new in the place of old in the buckets touched."""
    if touched:
        spark = old.sparkSession
        kept = written(new.drop("bucket"), "rewritten")
        left = _buckets(kept.select(bucket_of(F.col("region_id")).alias("bucket")))
        _laid_out(kept, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        for bucket in set(touched) - set(left):  # overwriting leaves a bucket without new rows as it is
            deleted(spark, f"{path}/bucket={bucket}")
        dropped(kept)
    return touched


def patched(spark: SparkSession, path: str, changes: DataFrame, key: str, files: int = 4) -> list[int]:
    """Puts the non-null values of changes (region_id, key, others; one row a key) into the table, and returns the buckets
    rewritten. region_id is where the row is; it can't be changed."""
    own = [c for c in changes.columns if c not in (key, "region_id")]
    named = changes.withColumn("bucket", bucket_of(F.col("region_id")))
    old = read(spark, path, _buckets(named))
    other = F.lit(False)
    for c in own:
        other = other | (F.col(f"_new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")))
    found = old.join(changes.select("region_id", key, *[F.col(c).alias(f"_new_{c}") for c in own]), ["region_id", key])
    touched = _buckets(found.filter(other))
    old = read(spark, path, touched)
    return _overwritten(path, old, patch(old, changes.drop("region_id"), key), touched, files)


def removed(spark: SparkSession, path: str, ids: DataFrame, files: int = 4) -> list[int]:
    """Deletes the rows that ids (region_id, and maybe other key columns) name; returns the buckets rewritten."""
    keys = ids.columns
    old = read(spark, path, _buckets(ids.withColumn("bucket", bucket_of(F.col("region_id")))))
    touched = _buckets(old.join(ids, keys, "left_semi"))
    old = read(spark, path, touched)
    return _overwritten(path, old, old.join(ids, keys, "left_anti").select(*old.columns), touched, files)


def appended(spark: SparkSession, path: str, batch: DataFrame, key: str, order: str, files: int = 4) -> int:
    """Adds the rows of batch whose key (unique within a region) the table lacks, reading the batch's buckets alone; returns
    how many. Null keys are always new."""
    named = batch.withColumn("bucket", bucket_of(F.col("region_id")))
    held = read(spark, path, _buckets(named))
    fresh = written(new_rows(held, batch, key, order), "fresh")
    n = fresh.count()
    if n:
        _laid_out(fresh, files).write.mode("append").partitionBy("bucket").parquet(path)
    dropped(fresh)
    return n
