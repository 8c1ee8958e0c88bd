"""Box and point arithmetic."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbgrid.functions.lookups import class_id

EARTH_RADIUS = 6378137.0
KM_PER_DEGREE = 111.0


def box_numbers(text: Column) -> Column:
    """JSON text of a list of numbers as array<double>."""
    return F.from_json(text, "array<double>")


def box_of_numbers(numbers: Column, text: Column) -> Column:
    """numbers if they are four, else the four items of text that can be cast to numbers, else null; each item is
    looked at by itself, as functions of arrays are not compiled."""
    parts = F.from_json(text, "array<string>")
    cast = [F.get(parts, F.lit(i)).try_cast("double") for i in range(4)]
    whole = lambda items, array: reduce(lambda a, x: a & x.isNotNull(), items, F.coalesce(F.size(array) == 4, F.lit(False)))
    return F.when(whole([F.get(numbers, F.lit(i)) for i in range(4)], numbers), numbers).when(whole(cast, parts), F.array(*cast))


def parsed_box(text: Column) -> Column:
    """JSON text of four numbers (numeric strings too) as array<double>; anything else is null."""
    return box_of_numbers(box_numbers(text), text)


def centre_box(box: Column, width: Column, height: Column, label: Column) -> Column:
    """struct<class_id,xc,yc,w,h> of a pixel corner box, as shares of the image; null for unlisted
    labels, missing sizes and boxes without area."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    fine = class_id(label).isNotNull() & (width > 0) & (height > 0) & (x1 > x0) & (y1 > y0)
    return F.when(fine, F.struct(class_id(label).alias("class_id"), ((x0 + x1) / 2 / width).alias("xc"), ((y0 + y1) / 2 / height).alias("yc"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h")))


def percent_to_centre(label: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<class_id,xc,yc,w,h> of a percent rectangle, clamped to the image; null as above."""
    clamp = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    part = lambda v: F.coalesce(v, F.lit(0.0)) / 100
    x0, y0 = clamp(part(x)), clamp(part(y))
    x1, y1 = clamp(x0 + part(w)), clamp(y0 + part(h))
    return F.when(class_id(label).isNotNull() & (x1 > x0) & (y1 > y0), F.struct(class_id(label).alias("class_id"), ((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def percent_rectangle(box: Column, width: Column, height: Column, label: Column) -> Column:
    """Annotation struct of a pixel corner box, in percent of the image."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    value = F.struct((100 * x0 / width).alias("x"), (100 * y0 / height).alias("y"), (100 * (x1 - x0) / width).alias("width"), (100 * (y1 - y0) / height).alias("height"), F.array(label).alias("rectanglelabels"))
    return F.struct(F.lit("rectanglelabels").alias("type"), width.alias("original_width"), height.alias("original_height"), value.alias("value"))


def box_around(lng: Column, lat: Column, degrees: float = 0.04) -> Column:
    return F.struct((lng - degrees).alias("min_lng"), (lat - degrees).alias("min_lat"), (lng + degrees).alias("max_lng"), (lat + degrees).alias("max_lat"))


def box_of_radius(lng: Column, lat: Column, km: Column) -> Column:
    """The box km around a point; a degree of longitude is shortened by the cosine of the latitude."""
    up, side = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * F.cos(F.radians(lat)))
    return F.struct((lng - side).alias("min_lng"), (lat - up).alias("min_lat"), (lng + side).alias("max_lng"), (lat + up).alias("max_lat"))


def in_box(lng: Column, lat: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a point is in (min_lng, min_lat, max_lng, max_lat), edges included."""
    return lng.between(box[0], box[2]) & lat.between(box[1], box[3])


def web_mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres."""
    return F.radians(lng) * EARTH_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS


def outline(box: tuple[Column, Column, Column, Column]) -> Column:
    """The closed ring of a box's corners, as array<struct<x,y>>."""
    a, b, c, d = box
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (c, b), (c, d), (a, d), (a, b))])
