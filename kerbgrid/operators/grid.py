"""A grid of many levels for joins of points with boxes and polygons.

Cells of level k have sides of 2 ** k. A shape lies at the level where its bounds touch at most nine cells (with
four, points would meet twice as many shapes in vain); a point looks up its cell at each level that shapes use, so large and small shapes meet points by
equal keys, and no cell size has to be chosen. A shape of many edges takes a lower level, with about as many
cells as edges: a cell holds only the edges that touch it and whether its lower right corner is inside, and
cells that no edge touches are kept only inside. What is shuffled is in proportion to the edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbgrid.scratch import written

#: Up to how many edges a shape is not cut into cells of its own; about how many edges such a cell touches.
FEW, IN_CELL = 64, 4
BOUNDS = ("bx0", "by0", "bx1", "by1")
#: Kinds of shapes: what their bounds say all of, those of few edges, and others.
BOX, SMALL, LARGE = "box", "small", "large"


def edges_of(rings: Column) -> Column:
    """The edges array<struct<ax,ay,bx,by>> of closed or open rings array<array<struct<x,y>>>; further rings
    are holes."""

    def of(r: Column) -> Column:
        closed = F.concat(r, F.slice(r, 1, 1))
        return F.transform(F.sequence(F.lit(1), F.size(r)), lambda k: F.struct(F.get(closed, k - 1)["x"].alias("ax"), F.get(closed, k - 1)["y"].alias("ay"), F.get(closed, k)["x"].alias("bx"), F.get(closed, k)["y"].alias("by")))

    return F.filter(F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of)), lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _at(e: Column, y: Column) -> Column:
    """Where an edge meets a height."""
    return F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]


def _on(x: Column, y: Column, e: Column) -> Column:
    on_line = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) == 0
    return on_line & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))


def crossed(x: Column, y: Column, e: Column) -> Column:
    """1 where a ray from a point to the right crosses an edge, else 0: the point is inside where the sum is odd."""
    return F.when((e["ay"] > y) != (e["by"] > y), x < _at(e, y)).otherwise(False).cast("int")


def crossed_in_cell(x: Column, y: Column, e: Column, right: Column, bottom: Column) -> Column:
    """As crossed, on the way to the corner (right, bottom) of the point's cell: right to the border of the cell at the
    height y and then down it, where only edges of the cell can be. The point is inside where the sum is odd and
    the corner is not, or the other way round. Whether an edge passes below a place on the border is told
    from where it meets that height, so both parts of the way agree on edges near their joint."""

    def below(height: Column) -> Column:
        crosses = (e["ax"] > right) != (e["bx"] > right)
        straddles = (e["ay"] > height) != (e["by"] > height)
        rising = (e["bx"] > e["ax"]) == (e["by"] > e["ay"])
        return crosses & F.when(straddles, (_at(e, height) <= right) != rising).otherwise(e["ay"] <= height)

    at = _at(e, y)
    way = F.when((e["ay"] > y) != (e["by"] > y), (x < at) & (at <= right)).otherwise(False)
    return (below(y) != below(bottom)).cast("int") + way.cast("int")


def edge_distance(x: Column, y: Column, e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    t = F.least(F.greatest(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.hypot(e["ax"] + t * dx - x, e["ay"] + t * dy - y)


def with_edges(polygons: DataFrame) -> DataFrame:
    """Polygons (rings array<array<struct<x,y>>>) with edges, their BOUNDS and their kind; polygons without edges
    are left out."""
    rows = polygons.withColumn("edges", F.explode(F.array(edges_of(F.col("rings"))))).drop("rings").filter(F.size("edges") > 0)
    end = lambda f, k: f(F.transform("edges", lambda e: e[k]))
    rows = rows.withColumns({"bx0": end(F.array_min, "ax"), "by0": end(F.array_min, "ay"), "bx1": end(F.array_max, "ax"), "by1": end(F.array_max, "ay")})
    corner = lambda e: ((e["ax"] == F.col("bx0")) | (e["ax"] == F.col("bx1"))) & ((e["ay"] == F.col("by0")) | (e["ay"] == F.col("by1"))) & ((e["ax"] == e["bx"]) | (e["ay"] == e["by"]))
    four = F.size(F.array_distinct(F.transform("edges", lambda e: F.struct(e["ax"], e["ay"])))) == 4
    boxy = F.when(F.size("edges") == 4, four & F.forall("edges", corner)).otherwise(False)
    return rows.withColumn("kind", F.when(boxy, BOX).when(F.size("edges") <= FEW, SMALL).otherwise(LARGE))


def level_of(extent: Column) -> Column:
    """The level whose cells are at least half as large as extent."""
    return F.ceil(F.log2(F.greatest(extent / 2, F.lit(1e-12)))).cast("int")


def side_of(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _span(low: Column, high: Column, side: Column) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def boxes_on_grid(boxes: DataFrame, reach: Column | None = None) -> DataFrame:
    """boxes (with BOUNDS) once for each of the at most nine cells within reach of them: level (unless they have
    one), cx, cy."""
    reach = F.lit(0.0) if reach is None else reach
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) + 2 * reach
    rows = boxes if "level" in boxes.columns else boxes.withColumn("level", level_of(extent))
    side = side_of(F.col("level"))
    rows = rows.withColumn("cx", F.explode(_span(F.col("bx0") - reach, F.col("bx1") + reach, side)))
    return rows.withColumn("cy", F.explode(_span(F.col("by0") - reach, F.col("by1") + reach, side)))


def placed(shapes: DataFrame) -> DataFrame:
    """Shapes of with_edges(), with a column reach, and the level they lie at."""
    many = F.greatest(F.floor(F.sqrt(F.size("edges") / IN_CELL)), F.lit(1))
    extent = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
    level = F.when(F.col("kind") == LARGE, level_of(F.greatest(extent / many, F.col("reach")))).otherwise(level_of(extent + 2 * F.col("reach")))
    return shapes.withColumn("level", level).withColumn("edges", F.when(F.col("kind") != BOX, F.col("edges")))


def cut(shapes: DataFrame, key: str) -> DataFrame:
    """LARGE shapes of placed() once for each cell that is inside or near an edge: level, cx, cy, edges
    (those within reach of the cell) and corner (whether its lower right corner is inside)."""
    side, reach = side_of(F.col("level")), F.col("reach")
    edges = shapes.select(key, "level", "reach", F.explode("edges").alias("e")).select(key, "level", "reach", "e", *[F.col(f"e.{c}").alias(c) for c in ("ax", "ay", "bx", "by")])
    low, high = (lambda a, b: F.least(F.col(a), F.col(b))), (lambda a, b: F.greatest(F.col(a), F.col(b)))
    # Where edges cross the lower borders of rows of cells.
    line = F.col("cy") * side
    crossings = edges.withColumn("cy", F.explode(_span(low("ay", "by"), high("ay", "by") + side, side)))
    crossings = crossings.filter((F.col("ay") > line) != (F.col("by") > line)).select(key, "cy", _at(F.col("e"), line).alias("at"))
    rows = crossings.groupBy(key, "cy").agg(F.collect_list("at").alias("at"))
    # Cells that an edge touches: for each column of cells the heights at which the edge passes it, with some slack.
    near = edges.withColumn("slack", reach + side * 1e-9)
    near = near.withColumn("cx", F.explode(_span(low("ax", "bx") - F.col("slack"), high("ax", "bx") + F.col("slack"), side)))
    slope = F.try_divide(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    at = lambda x: F.col("ay") + slope * (F.least(F.greatest(x, low("ax", "bx")), high("ax", "bx")) - F.col("ax"))
    one, two = at(F.col("cx") * side - F.col("slack")), at((F.col("cx") + 1) * side + F.col("slack"))
    bottom, top = F.when(slope.isNull(), low("ay", "by")).otherwise(F.least(one, two)), F.when(slope.isNull(), high("ay", "by")).otherwise(F.greatest(one, two))
    near = near.withColumn("cy", F.explode(_span(bottom - F.col("slack"), top + F.col("slack"), side)))
    near = near.groupBy(key, "cx", "cy").agg(F.collect_list("e").alias("edges"))
    whole = shapes.drop("edges")
    cells = whole.withColumn("cy", F.explode(_span(F.col("by0") - reach, F.col("by1") + reach, side))).join(rows, [key, "cy"], "left")
    cells = cells.withColumn("cx", F.explode(_span(F.col("bx0") - reach, F.col("bx1") + reach, side)))
    corner = F.size(F.filter(F.coalesce("at", F.array().cast("array<double>")), lambda x: x > (F.col("cx") + 1) * side)) % 2 == 1
    cells = cells.withColumn("corner", corner).drop("at").join(near, [key, "cx", "cy"], "left")
    return cells.filter("corner OR edges IS NOT NULL").withColumn("edges", F.coalesce("edges", F.array().cast(near.schema["edges"].dataType)))


def within_bounds(x: Column, y: Column) -> Column:
    c = F.col
    return (x > c("bx0")) & (x < c("bx1")) & (y > c("by0")) & (y < c("by1"))


def distance_to_bounds(x: Column, y: Column) -> Column:
    c = F.col
    dx, dy = F.greatest(c("bx0") - x, x - c("bx1"), F.lit(0.0)), F.greatest(c("by0") - y, y - c("by1"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def places(points: DataFrame, *at: str) -> DataFrame:
    """The distinct places of points: columns at, and place, a struct of them. What depends on the place alone is found once
    for it and joined to its points by at."""
    return points.select(*at).distinct().withColumn("place", F.struct(*at))


def met(points: DataFrame, polygons: DataFrame, point: str, key: str, x: str, y: str, reach: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """points with the polygons (key and rings) that they are strictly inside of; with reach (of BOUNDS) also with
    those whose bounds are within reach. point and key are unique; by are columns that must be equal. Besides
    the columns of both (which grouping takes: no maps): within, and gap (distance to the nearest edge, null inside or
    without one within reach). Shapes are written once. Boxes are told by their bounds alone; other shapes meet points
    edge by edge and are summed by point and shape, as that is compiled and functions of arrays are not. All pairs are
    rows: where points or polygons repeat, callers meet places() with distinct shapes."""
    c, px, py = F.col, F.col(x), F.col(y)
    reach_, near = (F.lit(0.0), False) if reach is None else (reach, True)
    shapes = written(placed(with_edges(polygons).withColumn("reach", reach_)), "shapes")
    levels = shapes.select("kind", "level").distinct().collect()
    kept, out = [f for f in dict.fromkeys([*points.columns, *polygons.columns]) if f != "rings"], []
    close = px.between(c("bx0") - c("reach"), c("bx1") + c("reach")) & py.between(c("by0") - c("reach"), c("by1") + c("reach"))
    for kind in (BOX, SMALL, LARGE):
        own = sorted(r["level"] for r in levels if r["kind"] == kind)
        if not own and (kind != BOX or levels):
            continue
        some = shapes.filter(c("kind") == kind)
        rows = joined_on_grid(points, (cut(some, key) if kind == LARGE else boxes_on_grid(some, c("reach"))).hint("merge"), x, y, by, own)
        rows = rows.filter(close if near else close & within_bounds(px, py))
        if kind == BOX:
            rows = rows.withColumn("within", within_bounds(px, py)).withColumn("gap", distance_to_bounds(px, py))
        else:
            side, e = side_of(c("level")), c("e")
            corner = c("corner") if kind == LARGE else F.lit(False)
            crossing = crossed(px, py, e) if kind == SMALL else crossed_in_cell(px, py, e, (c("cx") + 1) * side, c("cy") * side)
            each = rows.withColumn("corner", corner).withColumn("e", F.explode_outer("edges"))
            each = each.select(*kept, "corner", F.coalesce(crossing, F.lit(0)).alias("crossing"), F.coalesce(_on(px, py, e), F.lit(False)).alias("on"), *([edge_distance(px, py, e).alias("gap")] if near else []))
            sums = [F.sum("crossing").alias("crossing"), F.max("on").alias("on"), F.first("corner").alias("corner"), (F.min("gap") if near else F.lit(None).cast("double")).alias("gap")]
            # The other columns follow from point and key; as keys too, they leave only values that are summed by hash, not by sorting.
            rows = each.groupBy(point, key, *[f for f in kept if f not in (point, key)]).agg(*sums)
            rows = rows.withColumn("within", ((c("crossing") % 2 == 1) != c("corner")) & ~c("on"))
        rows = rows if near else rows.filter("within")
        out.append(rows.select(*kept, "within", F.when(~c("within"), c("gap")).alias("gap")))
    return reduce(DataFrame.unionByName, out)


def joined_on_grid(points: DataFrame, shapes: DataFrame, x: str, y: str, by: Sequence[str] = (), levels: Sequence[int] | None = None) -> DataFrame:
    """points with the rows of shapes (on the grid) in whose cell they lie, and equal columns by. levels in use
    are looked up unless given: few, as each is a power of two. Many shapes need hint("merge"): Spark takes the size of
    their files, before cells are exploded, for theirs, and would broadcast them through the driver."""
    if levels is None:
        levels = sorted(r["level"] for r in shapes.select("level").distinct().collect())
    rows = points.withColumn("level", F.explode(F.array(*map(F.lit, levels or [0]))))
    side = side_of(F.col("level"))
    rows = rows.withColumn("cx", F.floor(F.col(x) / side)).withColumn("cy", F.floor(F.col(y) / side))
    return rows.join(shapes, [*by, "level", "cx", "cy"])
