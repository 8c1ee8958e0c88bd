"""Expressions on small frames: edge cases of text, time, boxes and lookups."""

import math

import pytest
from pyspark.sql import functions as F

from kerbgrid.functions import boxes, lookups, text


def one(spark, column, schema="x string", row=(None,)):
    return spark.createDataFrame([row], schema).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("n", "label"), [(0, "0"), (1, "1-5"), (5, "1-5"), (6, "6-10"), (250, "101-250"), (251, "251-1000"), (1000, "251-1000"), (1001, None), (-1, None)])
def test_bins(spark, n, label):
    assert one(spark, lookups.count_bin(F.lit(n))) == label


def test_moments_are_utc(spark):
    stamp = lambda x: one(spark, F.date_format(text.moment(F.lit(x)), "yyyy-MM-dd HH:mm:ss"))
    assert stamp("1577836800000") == "2020-01-01 00:00:00" and stamp("2020-01-02T03:04:05Z") == "2020-01-02 03:04:05"
    assert stamp("soon") is None and stamp("") is None


def test_casefold_and_nfc(spark):
    same = lambda a, b: one(spark, text.caseless(F.lit(a)) == text.caseless(F.lit(b)))
    assert same(" Straße ", "STRASSE") and same("\u00c9cole", "e\u0301COLE") and same("ΣΑΣ", "σας") and same(None, "") and same("GROẞ", "gross") and same("ﬁn", "FIN")
    assert not same("İ", "i") and not same("Ecole", "École") and not same("a b", "ab")
    assert one(spark, text.nfc(F.lit("é"))) == "é"


def test_names_and_keys(spark):
    c = F.lit
    none = c(None).cast("timestamp")
    assert one(spark, text.region_name(c(1.0), c(2.0), c(3.0), c(4.0), c(False), none, none)) == "Region_1.000_2.000_3.000_4.000"
    assert one(spark, text.region_name(c(1.0), c(2.0), c(3.0), c(4.0), c(True), none, c("2020-01-02 03:04:05").cast("timestamp"))) == "Region_1.000_2.000_3.000_4.000_dense_end_20200102T030405"
    assert one(spark, text.source_key(c("7"), c(True), c(3))) == "7|dense|3" and one(spark, text.source_id(c("7|dense|3"))) == "7"
    assert one(spark, text.override(c(0), c(5))) == 5 and one(spark, text.override(c(2), c(5))) == 2
    assert one(spark, text.ratio(c(1), c(0))) == 0.0
    assert one(spark, text.clean_label(c("  "))) == "other" and one(spark, text.clean_label(c(" Bin "))) == "bin"


@pytest.mark.parametrize(("url", "kind", "suffix"), [("https://a/b.PNG?x=1", None, ".png"), ("https://a/b", "image/webp; q=1", ".webp"), (None, None, ".jpg"), ("not a url", "text/html", ".jpg")])
def test_suffix(spark, url, kind, suffix):
    assert one(spark, text.image_suffix(F.lit(url).cast("string"), F.lit(kind).cast("string"))) == suffix


@pytest.mark.parametrize(("raw", "out"), [("[1,2,3,4]", [1, 2, 3, 4]), ('["1",2,3,4]', [1, 2, 3, 4]), ("[1,2,3]", None), ("[1,2,3,\"x\"]", None), ("nonsense", None), (None, None)])
def test_parsed_box(spark, raw, out):
    assert one(spark, boxes.parsed_box(F.lit(raw).cast("string"))) == out


def test_boxes_round_trip(spark):
    box = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 60)])
    rect = one(spark, boxes.percent_rectangle(box, F.lit(100), F.lit(200), F.lit("bin")))["value"]
    centre = one(spark, boxes.centre_box(box, F.lit(100), F.lit(200), F.lit("bin")))
    again = one(spark, boxes.percent_to_centre(F.lit("bin"), *[F.lit(rect[k]) for k in ("x", "y", "width", "height")]))
    assert centre == pytest.approx(again) and centre["class_id"] == 2
    assert one(spark, boxes.centre_box(box, F.lit(100), F.lit(0), F.lit("bin"))) is None
    assert one(spark, boxes.centre_box(box, F.lit(100), F.lit(100), F.lit("other"))) is None
    clamped = one(spark, boxes.percent_to_centre(F.lit("bin"), F.lit(-10.0), F.lit(0.0), F.lit(200.0), F.lit(50.0)))
    assert (clamped["w"], clamped["xc"]) == (1.0, 0.5)


def test_radius_uses_the_cosine(spark):
    box = one(spark, boxes.box_of_radius(F.lit(0.0), F.lit(60.0), F.lit(111.0)))
    assert box["max_lng"] == pytest.approx(2.0) and box["max_lat"] == pytest.approx(61.0)


def test_mercator(spark):
    x, y = boxes.web_mercator(F.lit(180.0), F.lit(45.0))
    assert one(spark, x) == pytest.approx(math.pi * 6378137) and one(spark, y) == pytest.approx(5621521.486, abs=0.01)


@pytest.mark.parametrize(("tags", "kind", "wanted"), [
    ({"amenity": "bench", "power": "pole"}, "power", True), ({"power": "cable"}, "other", True), ({"highway": "street_lamp"}, "street_light", False),
    ({"traffic_sign": "x"}, "traffic_sign", False), ({"barrier": "bollard", "location": "indoor"}, "barrier", False), ({}, "other", False),
])
def test_feature_tags(spark, tags, kind, wanted):
    m = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    assert (one(spark, lookups.feature_class(m)), one(spark, lookups.feature_selected(m))) == (kind, wanted)
    assert one(spark, lookups.feature_name(m)) == next(iter(tags.values()), "")


@pytest.mark.parametrize(("use", "free", "out"), [("Mixed", None, "mixed-use"), (" Retail ", "park", "retail"), ("x", "park", "park/leisure/green"), (None, None, None)])
def test_land_use(spark, use, free, out):
    assert one(spark, lookups.land_use(F.lit(use).cast("string"), F.lit(free).cast("string"))) == out


@pytest.mark.parametrize(("some", "out"), [(["residential", "retail"], "mixed-use"), (["residential", "park/leisure/green"], "residential"), (["industrial", "mixed-use"], "mixed-use"), (["retail", "commercial"], "commercial")])
def test_resolution(spark, some, out):
    assert one(spark, lookups.resolved_land_use(F.array(*map(F.lit, some)))) == out
