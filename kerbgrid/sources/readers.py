"""Readers of landed inputs, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbgrid.functions.lookups import feature_class, feature_name
from kerbgrid.functions.text import moment

POINT_PAGE = "data array<struct<id:string,computed_geometry:struct<type:string,coordinates:array<double>>,thumb_1024_url:string,captured_at:string,width:int,height:int>>"
POSITION_PAGE = "result struct<data:array<map<string,string>>>"
FEATURES = "features array<struct<id:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
POLYGONS = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
_RESULT = "struct<id:string,type:string,value:struct<x:double,y:double,width:double,height:double,rectanglelabels:array<string>>>"
TASK_PAGE = f"tasks array<struct<id:string,data:struct<image_id:string,image:string>,annotations:string,predictions:string>>, results array<struct<id:string,data:struct<image_id:string,image:string>,annotations:string,predictions:string>>"


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in parts by ranges of a numeric column."""
    return spark.read.options(**options).jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line, quotes removed and doubled quotes single."""
    parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    return F.transform(parts, lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)))


def positional_cities(spark: SparkSession, path: str) -> DataFrame:
    """City lists without header: city, country, iso3, and the last two fields as the capture window
    where there are four at least; blank lines are skipped."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(csv_fields(F.col("value")).alias("f"))
    at = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit(""))
    window = lambda back: F.when(F.size("f") >= 4, F.nullif(F.get("f", F.size("f") - back), F.lit("")))
    return rows.select(at(0).alias("city"), at(1).alias("country"), at(2).alias("iso3"), window(2).alias("start_captured_at"), window(1).alias("end_captured_at"))


def headed_cities(spark: SparkSession, path: str, least_population: float | None = None) -> DataFrame:
    """City lists with header; ragged rows have nulls. Bad coordinates are null, population is whole."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    out = raw.select(
        text("city", "city_ascii").alias("city"), text("country").alias("country"), F.upper(text("iso3")).alias("iso3"),
        text("lng", "lon").try_cast("double").alias("lng"), text("lat").try_cast("double").alias("lat"), text("population").try_cast("double").cast("long").alias("population"),
        text("start_captured_at", "start_date", "start").alias("start_captured_at"), text("end_captured_at", "end_date", "end").alias("end_captured_at"),
    )
    return out if least_population is None else out.filter(F.col("population") >= least_population)


def geometry_pages(spark: SparkSession, path: str, source: str = "mapillary") -> DataFrame:
    """Image pages that hold a point geometry; missing coordinates are 0, 0."""
    rows = spark.read.schema(POINT_PAGE).option("multiLine", True).json(path).select(F.explode("data").alias("x"))
    place = lambda i: F.coalesce(F.get("x.computed_geometry.coordinates", F.lit(i)), F.lit(0.0))
    return rows.select(F.col("x.id").alias("id_from_source"), place(0).alias("lng"), place(1).alias("lat"), F.col("x.thumb_1024_url").alias("url"), moment(F.col("x.captured_at")).alias("source_captured_at"), F.lit(source).alias("source"), F.col("x.width").alias("width"), F.col("x.height").alias("height"))


def position_pages(spark: SparkSession, path: str, source: str = "kartaview") -> DataFrame:
    """Image pages with plain positions; a position that is not given is 0, 0, one that is no number is null. The size placeholder of URLs is filled in; the date added counts
    only where there is no shot date at all (a null shot date stays null)."""
    rows = spark.read.schema(POSITION_PAGE).option("multiLine", True).json(path).select(F.explode("result.data").alias("x"))
    x = lambda k: F.try_element_at("x", F.lit(k))
    place = lambda k: F.when(F.map_contains_key("x", F.lit(k)), x(k).try_cast("double")).otherwise(0.0).alias(k)
    day = F.when(F.map_contains_key("x", "shotDate"), x("shotDate")).otherwise(x("dateAdded"))
    return rows.select(x("id").alias("id_from_source"), place("lng"), place("lat"), F.replace(x("fileurl"), F.lit("{{sizeprefix}}"), F.lit("lth")).alias("url"), moment(day).alias("source_captured_at"), F.lit(source).alias("source"), x("width").try_cast("int").alias("width"), x("height").try_cast("int").alias("height"))


def canonical_images(rows: DataFrame) -> DataFrame:
    """Landed images fit for the images table: coordinates and time known, id not null."""
    return rows.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull() & F.col("source_captured_at").isNotNull() & F.col("id_from_source").isNotNull())


def feature_pages(spark: SparkSession, path: str) -> DataFrame:
    """Point features: osm_id, osm_type, name, lng, lat, tags; other geometries are left out."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("x"))
    rows = rows.filter((F.col("x.geometry.type") == "Point") & (F.size("x.geometry.coordinates") >= 2)).withColumn("tags", F.coalesce("x.properties", F.create_map().cast("map<string,string>")))
    return rows.select(F.col("x.id").alias("osm_id"), feature_class(F.col("tags")).alias("osm_type"), feature_name(F.col("tags")).alias("name"), F.col("x.geometry.coordinates")[0].alias("lng"), F.col("x.geometry.coordinates")[1].alias("lat"), "tags")


def polygon_pages(spark: SparkSession, path: str) -> DataFrame:
    """Polygons, and multipolygons one row a part: poly_id, part, landuse, leisure, rings (outline, then holes);
    polygons without points are left out. operators.shapes.regional attaches regions and cuts to their boxes."""
    rows = spark.read.schema(POLYGONS).option("multiLine", True).json(path).select(F.explode("features").alias("x"))
    polygon = "array<array<array<double>>>"
    one = F.when(F.col("x.geometry.type") == "Polygon", F.array(F.from_json("x.geometry.coordinates", polygon)))
    many = F.when(F.col("x.geometry.type") == "MultiPolygon", F.from_json("x.geometry.coordinates", f"array<{polygon}>"))
    tag = lambda k: F.try_element_at("x.properties", F.lit(k)).alias(k)
    rows = rows.select(F.col("x.id").alias("poly_id"), tag("landuse"), tag("leisure"), F.posexplode(F.coalesce(one, many)).alias("part", "parts"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = F.transform("parts", lambda r: F.filter(F.transform(r, point), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return rows.filter(F.size("parts") > 0).select("poly_id", "part", "landuse", "leisure", rings.alias("rings"))


def task_pages(spark: SparkSession, path: str) -> DataFrame:
    """Annotation tasks: task_id, image_id, annotations and predictions as flat result lists; lists may
    come as JSON text. Results of all annotations of a task are joined."""
    rows = spark.read.schema(TASK_PAGE).option("multiLine", True).json(path).select(F.explode(F.coalesce("tasks", "results")).alias("x"))

    def flat(column: str) -> Column:
        lists = F.from_json(F.col(column), f"array<struct<result:array<{_RESULT}>>>")
        items = F.flatten(F.transform(F.coalesce(lists, F.array().cast(f"array<struct<result:array<{_RESULT}>>>")), lambda a: F.coalesce(a["result"], F.array().cast(f"array<{_RESULT}>"))))
        kept = F.filter(items, lambda r: r["type"] == "rectanglelabels")
        return F.transform(kept, lambda r: F.struct(r["id"].alias("id"), F.get(r["value"]["rectanglelabels"], F.lit(0)).alias("label"), r["value"]["x"].alias("x"), r["value"]["y"].alias("y"), r["value"]["width"].alias("width"), r["value"]["height"].alias("height")))

    return rows.select(F.col("x.id").alias("task_id"), F.col("x.data.image_id").alias("image_id"), flat("x.annotations").alias("annotations"), flat("x.predictions").alias("predictions"))


def dataset_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """An NDJSON dataset: (meta line, records). schema has a column type."""
    rows = spark.read.schema(schema).json(path)
    return rows.filter("type = 'dataset'"), rows.filter("type is null or type <> 'dataset'").drop("type")


#: JPEG markers that start a frame, whose lengths are followed by height and width; those without a length.
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
BARE = (0x01, 0xD0, 0xD1, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8)
#: Marker steps before a JPEG's frame; a file with more of them has no size.
STEPS = 1024


def _big(content: Column, at: Column, n: int) -> Column:
    """The number of n bytes, highest first, at a place from 1; null beyond the end."""
    part = F.substring(content, at, F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def _little(content: Column, at: int, n: int) -> Column:
    return sum((_big(content, F.lit(at + i), 1) * (1 << 8 * i) for i in range(1, n)), _big(content, F.lit(at), 1))


def _jpeg_size(content: Column) -> Column:
    """struct<at,w,h>: walks from marker to marker to the first frame."""
    state = lambda at, w=None, h=None: F.struct(at.cast("long").alias("at"), (F.lit(None) if w is None else w).cast("long").alias("w"), (F.lit(None) if h is None else h).cast("long").alias("h"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker = _big(content, at + 1, 1)
        length = _big(content, at + 2, 2)
        return (
            F.when(at == 0, s)  # done
            .when(F.coalesce(_big(content, at, 1) != 255, F.lit(True)) | marker.isNull() | marker.isin(0xD9, 0xDA), state(F.lit(0)))
            .when(marker == 255, state(at + 1))
            .when(marker.isin(*BARE), state(at + 2))
            .when(marker.isin(*FRAMES), state(F.lit(0), _big(content, at + 7, 2), _big(content, at + 5, 2)))
            .otherwise(state(F.coalesce(at + 2 + length, F.lit(0))))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state(F.lit(1)), step)


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of the PNG, GIF, BMP, WebP and JPEG files in a folder, from their headers by byte
    arithmetic: no pixel is decoded and no Python runs. Files of other kinds, cut off before their size or without one
    (0) are dropped. Spark reads a file's bytes whole."""
    b = F.col("content")
    head = lambda at, text: F.substring(b, F.lit(at), F.lit(len(text))) == F.lit(text)
    low14 = lambda x, skip=0: F.shiftright(x, skip).bitwiseAND(F.lit(0x3FFF))
    pair = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    webp = head(1, b"RIFF") & head(9, b"WEBP")
    size = (
        F.when(head(1, b"\x89PNG\r\n\x1a\n"), pair(_big(b, F.lit(17), 4), _big(b, F.lit(21), 4)))
        .when(head(1, b"GIF8"), pair(_little(b, 7, 2), _little(b, 9, 2)))
        .when(head(1, b"BM"), pair(_little(b, 19, 4), F.abs(_little(b, 23, 4).cast("int"))))
        .when(webp & head(13, b"VP8 "), pair(low14(_little(b, 27, 2)), low14(_little(b, 29, 2))))
        .when(webp & head(13, b"VP8L"), pair(low14(_little(b, 22, 4)) + 1, low14(_little(b, 22, 4), 14) + 1))
        .when(webp & head(13, b"VP8X"), pair(_little(b, 25, 3) + 1, _little(b, 28, 3) + 1))
        .when(head(1, b"\xff\xd8"), F.transform(F.array(_jpeg_size(b)), lambda s: pair(s["w"], s["h"]))[0])
    )
    rows = spark.read.format("binaryFile").load(path).select("path", size.alias("size"))
    return rows.filter("size.width > 0 and size.height > 0").select("path", "size.width", "size.height")
