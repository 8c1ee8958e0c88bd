"""Shared helpers of the training-data operators: table access, Arrow row mapping, shared scratch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kerbgrid.scratch import dropped, written

__all__ = ["dropped", "map_rows", "only", "slices", "table", "written"]

#: Rows, and bytes of text, that a Python task turns into objects at once (one longer text is taken
#: alone): what bounds a worker's memory.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes of text."""
    sizes = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = min(max(int(np.searchsorted(ends, done + BYTES_AT_ONCE, "right")), at + 1), at + ROWS_AT_ONCE, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[list[list]], Iterable[tuple]]]) -> DataFrame:
    """Rows of df through a function of column lists, in Arrow batches cut into slices().

    make() runs once a task and returns the function; it gets one list for each column of df and
    yields output tuples in the order of schema.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for part in slices(whole):
                rows = list(f([c.to_pylist() for c in part.columns]))
                columns = list(zip(*rows)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the columns that an operator reads, cast; other columns, whatever their names, stay out."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])
