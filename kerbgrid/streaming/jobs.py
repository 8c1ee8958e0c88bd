"""Structured Streaming forms of the incremental behaviours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbgrid.operators import keyed
from kerbgrid.operators.ingest import new_rows, patch


def arriving_images(stream: DataFrame, at: str = "source_captured_at", delay: str = "1 hour") -> DataFrame:
    """A stream of images, each source id once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["id_from_source"])


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str = "id_from_source", order: str = "image_id") -> StreamingQuery:
    """Appends a stream's new keys to the Parquet table target. Each batch goes to a folder of its own
    number, so a batch that is repeated after a failure replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession.read.schema(batch.schema).option("recursiveFileLookup", True).parquet(target)
        old = held.filter(~F.col("_metadata.file_path").contains(f"/batch-{number:012d}/"))
        new_rows(old.select(key), batch, key, order).write.mode("overwrite").parquet(f"{target}/batch-{number:012d}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_keyed(stream: DataFrame, target: str, checkpoint: str, order: str = "image_id") -> StreamingQuery:
    """Appends a stream's new keys to a table of operators.keyed, reading only the files that may hold them. A batch
    that is repeated after a failure finds the keys it had added; rows without a key, which can't be told apart
    then, are left out."""
    key = keyed.key_of(stream.sparkSession, target)

    def store(batch: DataFrame, number: int) -> None:
        keyed.appended(batch.sparkSession, target, batch.filter(F.col(key).isNotNull()), order)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of a status log.
STATUS = "image_id string, status string, batch long"


def drained_worklist(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, log: str, checkpoint: str, done: str = "reviewed") -> StreamingQuery:
    """Drains a stream of images through a batch job, such as scoring, and writes their status back.

    Each batch's results go to a folder of its number under target; only then the status done of all its images, those
    without results too, goes to one under log. A batch repeated after a failure replaces both folders, so results
    and statuses stand once. Statuses are append-only; folded() puts the latest into the images."""

    def store(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch-{number:012d}")
        status = batch.select(F.col("image_id").cast("string"), F.lit(done).alias("status"), F.lit(number).cast("long").alias("batch"))
        status.filter("image_id is not null").distinct().write.mode("overwrite").parquet(f"{log}/batch-{number:012d}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All batches of a folder that the streams above wrote to; no rows before the first one."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def folded(images: DataFrame, log: DataFrame) -> DataFrame:
    """images with the status of their latest batch in the log (STATUS); images that it doesn't name keep theirs."""
    latest = log.groupBy("image_id").agg(F.max_by("status", "batch").alias("status"))
    return patch(images, latest.withColumn("image_id", F.col("image_id").cast(images.schema["image_id"].dataType)), "image_id")


def remaining(images: DataFrame, log: DataFrame, status: str = "unreviewed") -> DataFrame:
    """The worklist: images that still have this status once the log is folded in."""
    return folded(images, log).filter(F.col("status") == status)


def running_counts(stream: DataFrame) -> DataFrame:
    """region_id, n: for output mode update or complete."""
    return stream.groupBy("region_id").agg(F.count("*").alias("n"))


def calls_in_trailing_window(calls: DataFrame, key: str, at: Column, seconds: int = 60) -> DataFrame:
    """Each call with the number of calls of its key in the seconds up to it, the bound included. Calls
    are dealt by key and span of so many seconds, each to its own and as history to the next span, so
    that a key's calls don't meet in one task. A call without a time is kept, with null calls."""
    span = seconds * 1_000_000
    trailing = Window.partitionBy(key, "_span").orderBy("micros").rangeBetween(-span, 0)
    rows = calls.withColumn("micros", F.unix_micros(at)).withColumn("_own", F.floor(F.col("micros") / span))
    rows = rows.withColumn("_span", F.explode(F.when(F.col("_own").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("_own"), F.col("_own") + 1))))
    # Calls without a time are counted apart, and not as each other's.
    calls = F.when(F.col("_own").isNotNull(), F.count("micros").over(trailing))
    return rows.withColumn("calls", calls).filter("_own <=> _span").drop("_own", "_span")


def audited_calls(stream: DataFrame, key: str, at: str, seconds: int = 60, delay: int = 300) -> DataFrame:
    """The streaming form of calls_in_trailing_window, exact whatever the order of arrival: key, micros, calls, each
    call once, for output mode append.

    A call is state of its own span of so many seconds and, as history, of the next one. A span is complete, and
    its calls are counted and sent, when the watermark (delay seconds behind the latest call) passes its end; its
    state is dropped then. So state holds the calls of the open spans only, and a key's calls are spread over its
    spans. Calls that come later than the delay, or without a time, are not counted."""
    span = seconds * 1_000_000

    @F.pandas_udf("array<long>")
    def trailing(own: pd.Series, past: pd.Series) -> pd.Series:
        def count(now, before):
            now = np.sort(np.asarray(now, np.int64))
            all_ = np.sort(np.concatenate([now, np.asarray(before, np.int64)]))
            return np.searchsorted(all_, now, "right") - np.searchsorted(all_, now - span, "left")

        return pd.Series([count(a, b) for a, b in zip(own, past)])

    when = F.col(at).cast("timestamp")
    micros = F.unix_micros(when)
    shifted = F.timestamp_micros(micros + F.lit(span))
    sides = F.array(F.struct(when.alias("at"), micros.alias("own"), F.lit(None).cast("long").alias("past")), F.struct(shifted.alias("at"), F.lit(None).cast("long").alias("own"), micros.alias("past")))
    rows = stream.filter(when.isNotNull()).select(key, F.explode(sides).alias("_side")).select(key, F.col("_side.at").alias("_at"), F.col("_side.own").alias("_own"), F.col("_side.past").alias("_past"))
    # History is a span ahead of its call, and so the watermark follows a span further behind.
    spans = rows.withWatermark("_at", f"{delay + seconds} seconds").groupBy(key, F.window("_at", f"{seconds} seconds").alias("_span")).agg(F.array_sort(F.collect_list("_own")).alias("_own"), F.collect_list("_past").alias("_past"))
    counted = spans.filter(F.size("_own") > 0).select(key, F.col("_own").alias("micros"), trailing("_own", "_past").alias("calls"))
    return counted.select(key, F.explode(F.arrays_zip("micros", "calls")).alias("_call")).select(key, "_call.micros", "_call.calls")
