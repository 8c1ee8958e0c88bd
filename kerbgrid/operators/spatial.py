"""Tiles and spatial joins on the grid of grid.py: equal keys first, the geometry after; hot cells are left to
adaptive skew splitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbgrid.functions.boxes import EARTH_RADIUS, in_box, outline
from kerbgrid.functions.lookups import UNMATCHED, land_use, resolved_land_use
from kerbgrid.operators import grid

BOX = ("min_lng", "min_lat", "max_lng", "max_lat")


def tiles(regions: DataFrame, n: int, truncate: bool = True) -> DataFrame:
    """region_id, tile and box of about n cells of each region, longitude first. With truncate the
    cells from the n-th on are left out (a corner stays uncovered); without it all cover the box. A box
    without width or height has none."""
    nx = math.ceil(math.sqrt(n))
    ny = math.ceil(n / nx)
    w, h = (F.col("max_lng") - F.col("min_lng")) / nx, (F.col("max_lat") - F.col("min_lat")) / ny
    rows = regions.filter((F.col("max_lng") > F.col("min_lng")) & (F.col("max_lat") > F.col("min_lat"))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit((min(n, nx * ny) if truncate else nx * ny) - 1))))
    i, j = F.floor(F.col("tile") / ny), F.col("tile") % ny
    x, y = F.col("min_lng") + i * w, F.col("min_lat") + j * h
    return rows.select("region_id", F.col("tile").cast("long").alias("tile"), x.alias("x0"), y.alias("y0"), F.least(x + w, F.col("max_lng")).alias("x1"), F.least(y + h, F.col("max_lat")).alias("y1"))


def tile_of(lng: Column, lat: Column, n: int) -> Column:
    """The tile of a point within its region's box columns."""
    nx = math.ceil(math.sqrt(n))
    ny = math.ceil(n / nx)
    i = F.least(F.floor((lng - F.col("min_lng")) * nx / (F.col("max_lng") - F.col("min_lng"))), F.lit(nx - 1))
    j = F.least(F.floor((lat - F.col("min_lat")) * ny / (F.col("max_lat") - F.col("min_lat"))), F.lit(ny - 1))
    return i * ny + j


def capped_per_tile(images: DataFrame, regions: DataFrame, n: int, caps: dict[str, int]) -> DataFrame:
    """Images within their region's box, at most caps[source] of a source in each tile, by id; sources
    without a cap stay whole."""
    rows = images.join(regions.select("region_id", *BOX), "region_id").filter(in_box(F.col("lng"), F.col("lat"), tuple(map(F.col, BOX))))
    rows = rows.withColumn("tile", tile_of(F.col("lng"), F.col("lat"), n))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    order = Window.partitionBy("region_id", "source", "tile").orderBy("image_id")
    rows = rows.withColumn("place", F.row_number().over(order))
    return rows.filter(F.coalesce(F.col("place") <= F.try_element_at(cap, F.col("source")), F.lit(True))).select("image_id", "region_id", "source", "tile")


def regions_at_points(points: DataFrame, regions: DataFrame, dense: bool | None = None) -> DataFrame:
    """point_id, region_id (null: none) of the smallest region box that holds each point, ties by id.
    points: point_id, lng, lat."""
    some = regions if dense is None else regions.filter(F.col("dense_scan") == dense)
    boxes = grid.boxes_on_grid(some.select("region_id", *[F.col(a).alias(b) for a, b in zip(BOX, grid.BOUNDS)]))
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    found = grid.joined_on_grid(points, boxes, "lng", "lat").filter(in_box(F.col("lng"), F.col("lat"), tuple(map(F.col, grid.BOUNDS))))
    first = found.groupBy("point_id").agg(F.min(F.struct(area.alias("area"), "region_id"))["region_id"].alias("region_id"))
    return points.select("point_id").join(first, "point_id", "left")


def points_in_any(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """The points (point_id, x, y) strictly inside any polygon (poly_id, unique, and rings)."""
    shapes = polygons.groupBy("rings").agg(F.min("poly_id").alias("poly_id"))
    near = grid.met(grid.places(points, "x", "y"), shapes, "place", "poly_id", "x", "y")
    return points.join(near.select("x", "y").distinct(), ["x", "y"], "left_semi").select(points.columns)


def clipped(polygons: DataFrame, regions: DataFrame) -> DataFrame:
    """Polygons (region_id, x0, y0, side) as rings, cut to their region's box; those outside are dropped."""
    x0, y0 = F.greatest("x0", "min_lng"), F.greatest("y0", "min_lat")
    x1, y1 = F.least(F.col("x0") + F.col("side"), F.col("max_lng")), F.least(F.col("y0") + F.col("side"), F.col("max_lat"))
    rows = polygons.join(regions.select("region_id", *BOX), "region_id").filter((x1 > x0) & (y1 > y0))
    return rows.select(*polygons.columns, F.array(outline((x0, y0, x1, y1))).alias("rings"))


def land_use_of_points(points: DataFrame, polygons: DataFrame, radius: float, include_unmatched: bool = False, true_metres: bool = False) -> DataFrame:
    """point_id, land_use: of the polygons around a point, else of the nearest within radius (ties kept, to
    nine decimals; a radius of 0 takes none); a point's classes are resolved to one. points: point_id, region_id, x, y; polygons:
    poly_id (unique), region_id, landuse, leisure and rings (holes after the outer one) or x0, y0, side. Points at
    one place, and polygons of equal shape, meet as one: one candidate join on the grid of distinct places and shapes
    and one group by place, which keeps the least distance of each class. include_unmatched: points without any are
    UNMATCHED instead of left out. true_metres: coordinates are spherical Mercator metres and radius is
    on the ground, where these are shorter by the cosine of the latitude (below 80 degrees)."""
    x, y = F.col("x"), F.col("y")
    classed = polygons.withColumn("kind", land_use(F.col("landuse"), F.col("leisure"))).filter("kind is not null")
    stretch = lambda y: F.cosh(y / EARTH_RADIUS) if true_metres else F.lit(1.0)
    reach = 1e-8 + radius * stretch(F.greatest(F.abs("by0"), F.abs("by1")) + 8 * radius)
    same = ["region_id", "rings"] if "rings" in polygons.columns else ["region_id", "x0", "y0", "side"]
    shapes = classed.groupBy(*same).agg(F.min("poly_id").alias("poly_id"), F.collect_set("kind").alias("uses"))
    places = grid.places(points, "region_id", "x", "y")
    if "rings" in polygons.columns:
        near = grid.met(places, shapes, "place", "poly_id", "x", "y", reach if radius > 0 else None, ["region_id"])
    else:  # boxes need no edges
        boxes = shapes.select("region_id", "uses", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), (F.col("x0") + F.col("side")).alias("bx1"), (F.col("y0") + F.col("side")).alias("by1")).withColumn("reach", reach)
        close = x.between(F.col("bx0") - F.col("reach"), F.col("bx1") + F.col("reach")) & y.between(F.col("by0") - F.col("reach"), F.col("by1") + F.col("reach"))
        near = grid.joined_on_grid(places, grid.boxes_on_grid(boxes, F.col("reach")).hint("merge"), "x", "y", ["region_id"]).filter(close)
        near = near.withColumn("within", grid.within_bounds(x, y)).withColumn("gap", grid.distance_to_bounds(x, y))
    # Around a point comes before any distance.
    d = F.when(F.col("within"), -1.0).otherwise(F.round(F.col("gap") / stretch(y), 9))
    near = near.select("place", d.alias("d"), F.explode("uses").alias("kind")).filter((F.col("d") < 0) | ((F.col("d") <= radius) & F.lit(radius > 0)))
    least = near.groupBy("place", "kind").agg(F.min("d").alias("d"))
    found = least.groupBy("place").agg(F.collect_list(F.struct("d", "kind")).alias("all"))
    kinds = F.transform(F.filter("all", lambda c: c["d"] == F.array_min("all")["d"]), lambda c: c["kind"])
    found = found.select("place.*", resolved_land_use(kinds).alias("land_use"))
    rows = points.select("point_id", "region_id", "x", "y").join(found, ["region_id", "x", "y"], "left" if include_unmatched else "inner")
    return rows.select("point_id", F.coalesce("land_use", F.lit(UNMATCHED)).alias("land_use") if include_unmatched else F.col("land_use"))


def shape_box(default: Column, shape: Column, inside: Column, largest: float = 0.5) -> Column:
    """A shape's bounds where the centre is inside it and they are small enough, else the default box."""
    area = (shape["max_lng"] - shape["min_lng"]) * (shape["max_lat"] - shape["min_lat"])
    return F.when(inside & (area <= largest), shape).otherwise(default)
