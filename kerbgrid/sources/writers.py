"""Sinks. Values are formatted here, at the edge, and nowhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores_csv(scores: DataFrame, path: str, column: str) -> None:
    """Scores without header, highest first, as one file."""
    scores.orderBy(F.desc(column), "region_id").coalesce(1).write.mode("overwrite").csv(path, header=False)


def table_csv(rows: DataFrame, path: str, decimals: dict[str, int] | None = None) -> None:
    """A table with header; columns in decimals as text of so many decimals."""
    for column, n in (decimals or {}).items():
        rows = rows.withColumn(column, F.format_string(f"%.{n}f", F.col(column).cast("double")))
    rows.write.mode("overwrite").csv(path, header=True)


def dataset_ndjson(records: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Records (with a column split) as NDJSON, a folder for each split, and the one meta line."""
    for split in ("train", "val", "test"):
        records.filter(F.col("split") == split).write.mode("overwrite").json(f"{path}/{split}")
    spark = records.sparkSession
    spark.createDataFrame([{"type": "dataset", **meta}]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def task_batches(tasks: DataFrame, path: str) -> None:
    """Task payloads, a folder for each batch."""
    tasks.select("batch", "payload").write.mode("overwrite").partitionBy("batch").text(path)


def by_region(rows: DataFrame, path: str) -> None:
    """A layout of country, city and kind folders."""
    rows.write.mode("overwrite").partitionBy("country", "city", "kind").parquet(path)


def shards(records: DataFrame, path: str) -> None:
    """Records of shard_index, a folder for each shard."""
    records.repartitionByRange("shard").sortWithinPartitions("shard", "member").write.mode("overwrite").partitionBy("shard").parquet(path)
