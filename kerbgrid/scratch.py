"""Intermediate tables in the folder that all executors share, and running sums over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark) -> str:
    """spark.checkpoint.dir of the session. A fresh local folder is set only where there is none and the
    session runs in one process; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: later steps start from files, not from lineage."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from written() that no later step reads."""
    for table in tables:
        for name in table.inputFiles()[:1]:
            deleted(table.sparkSession, name.rpartition("/")[0])


#: Terms of a batch: of its columns and the places (from 0) of its rows in their group, one int64 column a sum.
Terms = Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]


def _plain(n: int, ahead: list[int], sums: list[int]) -> list[int]:
    return [a + b for a, b in zip(ahead, sums)]


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], what: str, sums: int, terms: Terms, modulus: Sequence[int] | None = None, joined: Callable[[int, list[int], list[int]], list[int]] = _plain) -> tuple[DataFrame, list[tuple]]:
    """rows with place (from 1) and running sums s0, s1, ... in their order within each group, of any size.

    Rows are dealt by ranges of group and order, and each task sums in one pass, anew for each group. So a
    group may span partitions; only the piece of it that starts a partition lacks what came before. Its
    rows have the partition's number in column piece (others null), and what they lack is returned as
    (piece, rows before, sums before), one row a partition at most: joined(n, before, own) are the sums of a
    piece after n rows. ahead() adds plain sums. terms makes the summands of a batch from its whole-number
    columns; modulus, if given, bounds each sum. Columns that start with an underscore only sort. Ties in the
    order must be between equal rows.
    """
    kept = [c for c in rows.columns if not c.startswith("_")]
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"s{i}" for i in range(sums)]
    added = [T.StructField(c, T.LongType()) for c in ("place", *names, "piece", "part")] + [T.StructField("edge", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, place, total, in_first, held = TaskContext.get().partitionId(), None, 0, np.zeros(sums, np.int64), True, None
        for batch in (b for b in batches if b.num_rows):
            n, starts = batch.num_rows, np.zeros(batch.num_rows, bool)
            for c in group:
                code = batch.column(kept.index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] |= code[1:] != code[:-1]
            row = lambda i: tuple(batch.column(kept.index(c))[i].as_py() for c in group)  # noqa: B023, E731
            starts[0] = now is not None and row(0) != now
            begun = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            goes_on = begun < 0
            places = np.where(goes_on, np.arange(n) + place, np.arange(n) - begun)
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(kept) if pa.types.is_integer(batch.schema.field(i).type)}
            cum = np.cumsum(terms(columns, places), 0)
            before = np.concatenate([np.zeros((1, sums), np.int64), cum])[np.maximum(begun, 0)]
            cum = cum - before + total * goes_on[:, None]
            cum = cum if modulus is None else cum % np.array(modulus)
            piece = goes_on & in_first
            in_first = bool(piece[-1])
            edge = np.zeros(n, bool)
            edge[0] = held is None
            own = [places + 1, *(np.ascontiguousarray(cum[:, i]) for i in range(sums))]
            now, place, total = row(n - 1), int(places[-1]) + 1, cum[-1]
            if held is not None:
                yield sent(*held)
            held = (batch, [*map(pa.array, own), pa.array(np.full(n, part), mask=~piece), pa.array(np.full(n, part))], edge)
        if held is not None:
            held[2][-1] = True
            yield sent(*held)

    def sent(batch: pa.RecordBatch, own: list[pa.Array], edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, *own, pa.array(edge)], names=[*kept, *[f.name for f in added]])

    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*kept)
    table = written(placed.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *added])), what)
    pieces, parts, now, n, total = [], set(), None, 0, [0] * sums
    for e in table.filter("edge").select("part", "piece", *group, "place", *names).orderBy("part", F.col("piece").isNull(), "place").collect():
        own, values, lacks = tuple(e[c] for c in group), [e[c] for c in names], (0, [0] * sums)
        if e["part"] not in parts and now == own:  # the partition's first row goes on with the group
            pieces.append((e["part"], n, total))
        if e["piece"] is not None and pieces and pieces[-1][0] == e["part"]:
            lacks = pieces[-1][1:]
        parts.add(e["part"])
        now, n, total = own, lacks[0] + e["place"], joined(*lacks, values)
    return table.drop("edge", "part"), pieces


def missing(table: DataFrame, pieces: list[tuple], sums: int) -> DataFrame:
    """table of running() with what its pieces lack, before_place and before_s0, ... (0 elsewhere). pieces is
    broadcast: a row a partition at most."""
    names = ["place", *[f"s{i}" for i in range(sums)]]
    if not pieces:
        return table.withColumns({f"before_{c}": F.lit(0).cast("long") for c in names})
    more = table.sparkSession.createDataFrame([(p, n, *s) for p, n, s in pieces], T.StructType([T.StructField(c, T.LongType()) for c in ("piece", *[f"before_{c}" for c in names])]))
    return table.join(F.broadcast(more), "piece", "left").withColumns({f"before_{c}": F.coalesce(f"before_{c}", F.lit(0)) for c in names})


def ahead(table: DataFrame, pieces: list[tuple], sums: int) -> DataFrame:
    """A table of running() whose places and plain sums are those of whole groups."""
    names = ["place", *[f"s{i}" for i in range(sums)]]
    rows = missing(table, pieces, sums).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in names})
    return rows.drop("piece", *[f"before_{c}" for c in names])
