"""Rings: clipping to boxes, areas, and the dissolving of polygons that share borders.

A ring is an array of structs x, y; the first ring of a polygon is its outline, further ones are holes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbgrid.operators import grid
from kerbgrid.scratch import dropped, written

RING = "array<struct<x:double,y:double>>"


def _followed(ring: Column) -> Column:
    """The point after each, the first after the last."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Signed area, positive for rings against the clock; 0 without points."""
    parts = F.zip_with(ring, _followed(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / 2


def _half(ring: Column, axis: str, bound: Column, low: bool) -> Column:
    """The part of a ring on one side of a line: points on it stay, and crossings come in between."""
    other = "y" if axis == "x" else "x"
    keeps = lambda p: (p[axis] >= bound) if low else (p[axis] <= bound)

    def step(p: Column, q: Column) -> Column:
        at = p[other] + (q[other] - p[other]) * F.try_divide(bound - p[axis], q[axis] - p[axis])
        cross = F.struct(*[(bound if c == axis else at).alias(c) for c in ("x", "y")])
        return F.array(F.when(keeps(p), p), F.when(keeps(p) != keeps(q), cross))

    return F.filter(F.flatten(F.zip_with(ring, _followed(ring), step)), lambda p: p.isNotNull())


def clipped_rings(rings: DataFrame, column: str, box: tuple[str, str, str, str]) -> DataFrame:
    """rings (one in column, on each row) cut to the box that columns give, by one half-plane after another; what is
    left of a ring with parts outside may run along the box's sides more than once, which changes neither
    its area nor what is inside. Rings without area left are dropped. Each cut is a column of its own, as
    the next one reads it several times."""
    for axis, bound, low in (("x", box[0], True), ("y", box[1], True), ("x", box[2], False), ("y", box[3], False)):
        rings = rings.withColumn(column, F.explode(F.array(_half(F.col(column), axis, F.col(bound), low))))
    return rings.filter(F.size(column) > 2).filter(ring_area(F.col(column)) != 0)


def bounds_of(rings: Column) -> list[Column]:
    flat = F.flatten(rings)
    end = lambda f, k: f(F.transform(flat, lambda p: p[k]))
    return [end(F.array_min, "x").alias("bx0"), end(F.array_min, "y").alias("by0"), end(F.array_max, "x").alias("bx1"), end(F.array_max, "y").alias("by1")]


def regional(polygons: DataFrame, regions: DataFrame) -> DataFrame:
    """Polygons (poly_id, rings and others), once for each region whose box they share some area with, cut to it, holes
    kept: region_id and the columns of polygons. Polygons look up the cells of their bounds at each level of
    the grid that regions lie at; of several shared cells only one counts."""
    c = F.col
    boxes = grid.boxes_on_grid(regions.select("region_id", *[c(a).alias(b) for a, b in zip(("min_lng", "min_lat", "max_lng", "max_lat"), grid.BOUNDS)]))
    levels = sorted(r["level"] for r in boxes.select("level").distinct().collect())
    boxes = boxes.select("region_id", "level", "cx", "cy", *[c(b).alias(f"r_{b}") for b in grid.BOUNDS])
    own = [x for x in polygons.columns if x != "region_id"]
    rows = polygons.select(*own, *bounds_of(c("rings"))).withColumn("level", F.explode(F.array(*map(F.lit, levels or [0]))))
    side = grid.side_of(c("level"))
    rows = rows.withColumn("cx", F.explode(F.sequence(F.floor(c("bx0") / side), F.floor(c("bx1") / side)))).withColumn("cy", F.explode(F.sequence(F.floor(c("by0") / side), F.floor(c("by1") / side))))
    near = rows.join(boxes, ["level", "cx", "cy"])
    near = near.filter((c("bx0") < c("r_bx1")) & (c("bx1") > c("r_bx0")) & (c("by0") < c("r_by1")) & (c("by1") > c("r_by0")))
    near = near.filter((c("cx") == F.floor(F.greatest("bx0", "r_bx0") / side)) & (c("cy") == F.floor(F.greatest("by0", "r_by0") / side)))
    whole = (c("bx0") >= c("r_bx0")) & (c("bx1") <= c("r_bx1")) & (c("by0") >= c("r_by0")) & (c("by1") <= c("r_by1"))
    near = near.select("region_id", *own, *[f"r_{b}" for b in grid.BOUNDS], whole.alias("whole"))
    rest = near.filter("NOT whole").select("*", F.posexplode("rings").alias("at", "ring")).drop("rings")
    rest = clipped_rings(rest, "ring", tuple(f"r_{b}" for b in grid.BOUNDS))
    keys = ["region_id", "poly_id", *(["part"] if "part" in own else [])]
    parts = F.array_sort(F.collect_list(F.struct("at", "ring")))
    rest = rest.groupBy(*keys).agg(parts.alias("parts"), *[F.first(x).alias(x) for x in own if x not in keys and x != "rings"])
    # What is left of holes without their outline is nothing.
    rest = rest.filter(F.get("parts", F.lit(0))["at"] == 0).withColumn("rings", F.transform("parts", lambda p: p["ring"]))
    return near.filter("whole").select("region_id", *own).unionByName(rest.select("region_id", *own))


def border_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Directed edges keys, ax, ay, bx, by of the polygons' union for each of keys, its inside on their left: edges that
    two polygons share in opposite directions are gone, by one sum over canonical edges. Polygons must not
    overlap, and share borders corner by corner (equal coordinates)."""
    c = F.col
    # Dealt anew, as one small file may hold very many polygons, and one task would sum the edges of them all.
    rings = polygons.select(*keys, "rings").repartition(*keys, "rings").select(*keys, F.posexplode("rings").alias("at", "ring")).filter(F.size("ring") > 2)
    ring = F.when((ring_area(c("ring")) > 0) == (c("at") == 0), c("ring")).otherwise(F.reverse("ring"))
    rows = rings.select(*keys, F.explode(F.array(ring)).alias("ring"))
    pairs = F.zip_with("ring", _followed(c("ring")), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    rows = rows.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*").filter("ax <> bx OR ay <> by")
    up = (c("ax") < c("bx")) | ((c("ax") == c("bx")) & (c("ay") < c("by")))
    swap = lambda a, b: F.when(up, c(a)).otherwise(c(b))
    net = rows.select(*keys, swap("ax", "bx").alias("lx"), swap("ay", "by").alias("ly"), swap("bx", "ax").alias("hx"), swap("by", "ay").alias("hy"), F.when(up, 1).otherwise(-1).alias("way"))
    net = net.groupBy(*keys, "lx", "ly", "hx", "hy").agg(F.sum("way").alias("way")).filter("way <> 0")
    net = net.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs(c("way")).cast("int"))))
    turn = lambda a, b: F.when(c("way") > 0, c(a)).otherwise(c(b))
    return net.select(*keys, turn("lx", "hx").alias("ax"), turn("ly", "hy").alias("ay"), turn("hx", "lx").alias("bx"), turn("hy", "ly").alias("by"))


def _linked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """id, next of edges (id, keys, ax, ay, bx, by): at each corner an edge goes on with the one that comes first
    clockwise from the way back, so rings that touch at a corner stay apart."""
    c = F.col
    outs = edges.select(*keys, c("ax").alias("x"), c("ay").alias("y"), F.atan2(c("by") - c("ay"), c("bx") - c("ax")).alias("angle"), "id", F.lit(1).alias("out"))
    ins = edges.select(*keys, c("bx").alias("x"), c("by").alias("y"), F.atan2(c("ay") - c("by"), c("ax") - c("bx")).alias("angle"), "id", F.lit(0).alias("out"))
    corner = Window.partitionBy(*keys, "x", "y")
    rows = outs.unionByName(ins).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "x", "y", "out").orderBy("angle", "id")))
    first_out, first_in = F.min(F.when(c("out") == 1, c("angle"))).over(corner), F.min(F.when(c("out") == 0, c("angle"))).over(corner)
    n = F.count_if(c("out") == 1).over(corner)
    # An in-edge of rank k meets the out-edge of rank k, or k - 1 where the smallest angle is of an in-edge.
    rank = F.when(c("out") == 1, c("k")).otherwise(F.pmod(c("k") - 1 - (first_in < first_out).cast("int"), n) + 1)
    rows = rows.withColumn("slot", rank)
    return rows.groupBy(*keys, "x", "y", "slot").agg(F.max(F.when(c("out") == 0, c("id"))).alias("id"), F.max(F.when(c("out") == 1, c("id"))).alias("next")).select("id", "next")


def _jumped(links: DataFrame, start: dict[str, Column], step) -> DataFrame:
    """Pointer jumping on links (id, to): each round takes in what the row that to points at has gathered, and goes on
    from where that one points, so a ring of n edges takes log2(n) rounds. Rounds are written, the one before
    is deleted. Ends once no row changes."""
    now = written(links.withColumns(start), "jump")
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), *[F.col(x).alias(f"{x}2") for x in start])
        after = written(now.join(ahead, "to").select("id", F.col("to2").alias("to"), *[v.alias(k) for k, v in step.items()], reduce(lambda a, b: a | b, [v != F.col(k) for k, v in step.items()]).alias("moved")), "jump")
        moved = not after.filter("moved").isEmpty()
        dropped(now)
        now = after.drop("moved")
        if not moved:
            return now


def dissolved(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """One row a ring of the union of polygons (keys, rings) for each of keys: keys, ring_id, ring (open, its inside on the
    left: outlines run against the clock, holes with it), area (signed). Only a ring's own points meet in a
    row. See border_edges for what polygons must be."""
    c = F.col
    edges = written(border_edges(polygons, keys).withColumn("id", F.monotonically_increasing_id()), "edges")
    links = written(_linked(edges, keys), "links")
    # The smallest id of each ring names it, and is where it starts.
    named = _jumped(links.withColumnRenamed("next", "to"), {"ring_id": c("id")}, {"ring_id": F.least("ring_id", "ring_id2")})
    lead = links.join(named.select("id", "ring_id"), "id")
    chain = lead.select("id", F.when(c("next") == c("ring_id"), c("id")).otherwise(c("next")).alias("to"), F.when(c("next") == c("ring_id"), 0).otherwise(1).cast("long").alias("d"))
    # Steps to the last edge of the ring: that one points at itself.
    ranked = _jumped(chain.select("id", "to", "d"), {"left": c("d")}, {"left": c("left") + c("left2")})
    rows = edges.join(named.select("id", "ring_id"), "id").join(ranked.select("id", "left"), "id")
    rows = rows.groupBy(*keys, "ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-c("left")).alias("at"), c("ax").alias("x"), c("ay").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return rows.withColumn("area", ring_area(c("ring")))
