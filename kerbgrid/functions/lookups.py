"""Fixed lookup values, as SQL literals; small enough to stand in the plan instead of a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each listed detection label.
SEVERITY = {"billboard": 0.9, "graffiti": 0.4, "pothole": 0.1, "utility_pole": 0.3, "bin": 0.2, "road_sign": 0.0, "barrier": 0.1, "mobile_advertisement": 0.05, "shop_sign": 0.05}
#: Weight of each listed feature type.
FEATURE_SEVERITY = {"billboard": 0.9, "power": 0.3, "bin": 0.2, "barrier": 0.1, "traffic_sign": 0.0, "traffic_light": 0.0, "street_light": 0.0, "other": 0.0}
#: Share of the feature index in the blend, and least images and features of a score.
FEATURE_WEIGHT = 0.5
MIN_IMAGES = MIN_FEATURES = 300
#: Detector classes, in the order of their ids.
CLASSES = ("barrier", "billboard", "bin", "graffiti", "mobile_advertisement", "pothole", "road_sign", "shop_sign", "utility_pole")
#: Reported land uses, by priority.
LAND_USES = ("commercial", "residential", "industrial", "retail", "park/leisure/green")
MIXED_USE = "mixed-use"
#: Label of points without any land use, where they are asked for.
UNMATCHED = "unmatched"
#: Tag values of each land use.
MIXED_TAGS = ("mixed", "mixed_use", "mixed-use")
PLAIN_TAGS = ("commercial", "residential", "industrial", "retail")
GREEN_LANDUSE = ("grass", "forest", "meadow", "village_green", "recreation_ground", "allotments", "cemetery")
GREEN_LEISURE = ("park", "garden", "nature_reserve", "common", "golf_course", "pitch", "playground", "dog_park", "sports_centre", "recreation_ground")
#: Fixed values: (tag, values or None for any, class), first that holds.
FEATURE_RULES = (
    ("amenity", ("waste_basket", "waste_disposal", "recycling"), "bin"),
    ("power", ("pole", "tower", "portal", "catenary_mast"), "power"),
    ("advertising", ("billboard", "poster_box", "column"), "billboard"),
    ("barrier", ("block", "bollard", "jersey_barrier"), "barrier"),
    ("highway", ("street_lamp",), "street_light"),
    ("highway", ("traffic_signals",), "traffic_light"),
    ("traffic_sign", None, "traffic_sign"),
)
#: Features that are asked for: (tag, value or None for any).
FEATURE_SELECTORS = (("amenity", "waste_basket"), ("power", None), ("advertising", "billboard"), ("barrier", None), ("highway", "traffic_signals"))
#: Right-closed bins of counts.
CATEGORIES = ((0, "0"), (5, "1–5"), (10, "5–10"), (25, "10–25"), (50, "25–50"), (100, "50–100"), (250, "100–250"), (1000, "250+"))
#: The same bins under labels of our own, which name both ends.
BINS = ((0, "0"), (5, "1-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (250, "101-250"), (1000, "251-1000"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def weight(label: Column, weights: dict[str, float]) -> Column:
    """The weight of a listed label; null for others."""
    return F.try_element_at(literal_map(weights), label)


def class_id(label: Column) -> Column:
    return F.try_element_at(literal_map({x: i for i, x in enumerate(CLASSES)}), label)


def class_name(number: Column) -> Column:
    return F.try_element_at(literal_map(dict(enumerate(CLASSES))), number)


def count_bin(n: Column, bins: tuple = BINS) -> Column:
    """Label of the bin of a count; null above the last and below 0."""
    out = F.when(n < 0, None)
    for top, label in bins:
        out = out.when(n <= top, label)
    return out


def feature_class(tags: Column) -> Column:
    """Class of a tag map; a tag whose value isn't listed falls through to the next rule."""
    out = None
    for tag, values, kind in FEATURE_RULES:
        value = F.try_element_at(tags, F.lit(tag))
        holds = value.isin(*values) if values else F.map_contains_key(tags, tag)
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.otherwise("other")


def feature_selected(tags: Column) -> Column:
    """Whether a feature is asked for, and its location absent or outdoor."""
    wanted = F.lit(False)
    for tag, value in FEATURE_SELECTORS:
        wanted = wanted | (F.map_contains_key(tags, tag) if value is None else F.coalesce(F.try_element_at(tags, F.lit(tag)) == value, F.lit(False)))
    return wanted & (F.coalesce(F.try_element_at(tags, F.lit("location")), F.lit("outdoor")) == "outdoor")


def feature_name(tags: Column) -> Column:
    return F.coalesce(F.try_element_at(F.map_values(tags), F.lit(1)), F.lit(""))


def land_use(landuse: Column, leisure: Column) -> Column:
    """Land-use class of a polygon's tags; null where none holds."""
    use, free = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (landuse, leisure))
    return F.when(use.isin(*MIXED_TAGS), MIXED_USE).when(use.isin(*PLAIN_TAGS), use).when(use.isin(*GREEN_LANDUSE) | free.isin(*GREEN_LEISURE), LAND_USES[-1])


def resolved_land_use(some: Column) -> Column:
    """One class of a set of them: residential with a business class is mixed, then by priority."""
    has = lambda x: F.array_contains(some, x)
    out = F.when(has("residential") & (has("commercial") | has("retail") | has("industrial")), MIXED_USE).when(has(MIXED_USE), MIXED_USE)
    for x in LAND_USES:
        out = out.when(has(x), x)
    return out
