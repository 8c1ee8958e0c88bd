"""Appends of new keys that read only the files that may hold them.

A table of this kind has its rows in folders bucket=N by hash of its key. Beside them, in _filters, stands for each
file the smallest and largest key and a Bloom filter of its keys: words of 64 bits, as many as a power of two, of
which a key sets BITS bits in one. A batch of keys meets the filters of its buckets by one join on bucket, size
of filter and word; only files with a word that holds all bits of a key, and the key within their range, are
read and compared. A filter has no false negatives, so a key that is held is always found.

Files are written before their filters. A file without filters, which a failure between both leaves, is always
read and gets its filters at the next append. An append repeated after a failure finds the keys that it had added.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbgrid.operators.ingest import new_rows
from kerbgrid.scratch import dropped, written

#: Folders of a table, bits that a key sets, and bits of a filter for each key, at least.
BUCKETS, BITS, ROOM = 64, 4, 24
#: Hashes of a key for its folder and its bits differ, as a folder's keys share the first one's remainder.
_FOLDER, _PLACE = 17, 29


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(_FOLDER)), F.lit(buckets)).cast("int")


def _mask(hashed: Column) -> Column:
    """The bits of a key, from the upper parts of its hash."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def _word(hashed: Column, level: Column) -> Column:
    """The word of a key in a filter of 2 to the level words."""
    return hashed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1)


def _append(rows: DataFrame, path: str, key: str, buckets: int, files: int) -> None:
    """rows into their folders, dealt to files tasks a folder at most; rows with equal or null keys are spread too."""
    spread = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in rows.columns]), F.lit(files))
    rows.withColumn("bucket", _bucket(F.col(key), buckets)).repartition(F.col("bucket"), spread).write.mode("append").partitionBy("bucket").parquet(path)


def _layout(spark: SparkSession, path: str) -> tuple[str, int, T.StructType]:
    """The table's key, number of buckets and columns, bucket included."""
    row = spark.read.schema("key string, buckets int, columns string").parquet(f"{path}/_layout").first()
    return row["key"], row["buckets"], T.StructType.fromJson(json.loads(row["columns"]))


def key_of(spark: SparkSession, path: str) -> str:
    return _layout(spark, path)[0]


def _files(spark: SparkSession, path: str) -> dict[tuple[int, str], str]:
    """The table's files by bucket and name (a name is that of its task, and may stand in several buckets)."""
    out = {}
    for name in spark.read.schema(_layout(spark, path)[2]).parquet(path).inputFiles():
        folder, _, file = name.rpartition("/")
        out[int(folder.rpartition("bucket=")[2]), file] = name
    return out


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The table's rows in some of its files."""
    columns = _layout(spark, path)[2]
    return spark.read.schema(columns).option("basePath", path).parquet(*names) if names else spark.createDataFrame([], columns)


def filters(spark: SparkSession, path: str) -> DataFrame:
    """bucket, file, level, low, high, word, bits: one row for each word of a file's filter that isn't 0, and one without a word
    (-1) for each file. low and high are of the key's type."""
    return spark.read.parquet(f"{path}/_filters")


def _filtered(rows: DataFrame, key: str) -> DataFrame:
    """The filters of rows, which have the table's columns and are read from files."""
    keys = rows.select("bucket", F.col("_metadata.file_name").alias("file"), F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(_PLACE)).alias("hashed"))
    sizes = keys.groupBy("bucket", "file").agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    level = F.ceil(F.log2(F.greatest(F.col("n") * ROOM / 64, F.lit(1.0)))).cast("int")
    sizes = sizes.select("bucket", "file", level.alias("level"), "low", "high")
    # A row a file is small for certain; files of keys look small too, and would be broadcast and joined in one task.
    placed = keys.filter("key IS NOT NULL").join(F.broadcast(sizes), ["bucket", "file"]).select("bucket", "file", "level", "low", "high", _word(F.col("hashed"), F.col("level")).alias("word"), _mask(F.col("hashed")).alias("bits"))
    words = placed.groupBy("bucket", "file", "level", "low", "high", "word").agg(F.bit_or("bits").alias("bits"))
    return words.unionByName(sizes.withColumns({"word": F.lit(-1).cast("long"), "bits": F.lit(0).cast("long")}))


def refiltered(spark: SparkSession, path: str) -> int:
    """Writes the filters of all files that have none, and returns their number."""
    key, _, _ = _layout(spark, path)
    files, known = _files(spark, path), _known(spark, path)
    lacking = sorted(name for k, name in files.items() if k not in known)
    if lacking:
        _filtered(_read(spark, path, lacking), key).write.mode("append").parquet(f"{path}/_filters")
    return len(lacking)


def _known(spark: SparkSession, path: str) -> set[tuple[int, str]]:
    """Bucket and name of the files that have filters."""
    return {(r["bucket"], r["file"]) for r in filters(spark, path).filter("word = -1").select("bucket", "file").collect()}


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, files: int = 1) -> None:
    """A new table at path with the rows, as they are, and their filters."""
    spark = rows.sparkSession
    columns = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("bucket", T.IntegerType())])
    spark.createDataFrame([(key, buckets, columns.json())], "key string, buckets int, columns string").write.parquet(f"{path}/_layout")
    kind = rows.schema[key].dataType.simpleString()
    spark.createDataFrame([], f"bucket int, file string, level int, low {kind}, high {kind}, word long, bits long").write.parquet(f"{path}/_filters")
    _append(rows, path, key, buckets, files)
    refiltered(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_layout(spark, path)[2]).parquet(path).drop("bucket")


def candidates(spark: SparkSession, path: str, batch: DataFrame) -> list[str]:
    """The files that may hold a key of batch: those whose filter says so, and those without one. The list of a table's
    files is all that the driver gets."""
    key, buckets, _ = _layout(spark, path)
    table, held = _files(spark, path), filters(spark, path)
    levels = [r["level"] for r in held.select("level").distinct().collect()]  # as many as filters have sizes
    hashed = F.xxhash64(F.col("key"), F.lit(_PLACE))
    keys = batch.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    keys = keys.select("key", _bucket(F.col("key"), buckets).alias("bucket"), hashed.alias("hashed"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    asked = keys.select("key", "bucket", "level", _word(F.col("hashed"), F.col("level")).alias("word"), _mask(F.col("hashed")).alias("mask"))
    found = asked.join(held.hint("merge"), ["bucket", "level", "word"]).filter("key BETWEEN low AND high AND (bits & mask) = mask")
    said = {(r["bucket"], r["file"]) for r in found.select("bucket", "file").distinct().collect()}
    known = _known(spark, path)
    return sorted(name for k, name in table.items() if k in said or k not in known)


def appended(spark: SparkSession, path: str, batch: DataFrame, order: str, files: int = 1) -> tuple[int, int]:
    """Adds the rows of batch, the first of each key by order, whose key the table lacks; rows with a null key are all
    new. Returns how many were added and how many files were read for it."""
    key, buckets, _ = _layout(spark, path)
    given = written(batch, "given")  # read twice: for the filters and for its rows
    reached = candidates(spark, path, given)
    fresh = written(new_rows(_read(spark, path, reached).select(key).hint("merge"), given, key, order), "fresh")
    n = fresh.count()
    if n:
        _append(fresh, path, key, buckets, files)
    refiltered(spark, path)
    dropped(given, fresh)
    return n, len(reached)
