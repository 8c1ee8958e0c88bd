"""Running sums by ranges against a plain loop, with groups that span partitions."""

import random

import pytest
from pyspark.sql import functions as F

from kerbgrid import scratch


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_running_sums_of_groups_across_partitions(spark, parts):
    draw = random.Random(parts)
    rows = [(draw.choice([None, "a", "b", "c"]) if i % 3 else "hot", i, draw.randrange(9)) for i in range(700)] + [("one", -1, 5)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        table, pieces = scratch.running(df, ["g"], ["i"], "sums", 1, lambda c, places: c["v"][:, None])
        got = {(r["g"], r["i"]): (r["place"], r["s0"]) for r in scratch.ahead(table, pieces, 1).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want, n, total = {}, {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n[g], total[g] = n.get(g, 0) + 1, total.get(g, 0) + v
        want[g, i] = n[g], total[g]
    assert got == want and (parts == 1 or pieces)


def test_running_sums_without_groups_and_without_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    table, pieces = scratch.running(df, [], [F.col("id").desc()], "sums", 1, lambda c, places: c["v"][:, None])
    got = {r["id"]: r["place"] for r in scratch.ahead(table, pieces, 1).collect()}
    assert got == {i: 1000 - i for i in range(1000)}
    table, pieces = scratch.running(df.limit(0), [], ["id"], "sums", 1, lambda c, places: c["v"][:, None])
    assert scratch.ahead(table, pieces, 1).count() == 0 and pieces == []
