"""Text, time and key expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def caseless(text: Column) -> Column:
    """Trimmed text that filters, joins, groups and sorts compare without regard to case, by Unicode's collation: STRASSE
    equals Straße (capitals spell out ß and ligatures), and composed letters equal decomposed ones; accents count, so
    İ differs from i, while the dotless ı equals it. Null is the empty text."""
    return F.collate(F.upper(F.lower(F.trim(F.coalesce(text, F.lit(""))))), "UNICODE_CI")


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def norm(text: Column) -> Column:
    """Trimmed lower case, all in the JVM; compares as caseless does for ASCII text."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_label(label: Column, missing: str = "other") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(label)), F.lit("")), F.lit(missing))


def override(new: Column, old: Column) -> Column:
    """New where it holds something (not null, blank or 0), else old."""
    return F.coalesce(F.when(~new.cast("string").isin("", "0", "0.0", "false"), new), old)


def moment(value: Column) -> Column:
    """A timestamp of text that is epoch milliseconds or a date and time; else null. Times are UTC."""
    millis = F.when(value.rlike(r"^-?[0-9]{1,18}$"), F.timestamp_millis(F.expr("0L") + value.try_cast("bigint")))
    return F.coalesce(millis, F.try_to_timestamp(value))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def region_name(lng0: Column, lat0: Column, lng1: Column, lat1: Column, dense: Column, start: Column, end: Column) -> Column:
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    base = F.format_string("Region_%.3f_%.3f_%.3f_%.3f", lng0, lat0, lng1, lat1)
    return F.concat_ws("_", base, F.when(dense, "dense"), F.concat(F.lit("start_"), stamp(start)), F.concat(F.lit("end_"), stamp(end)))


def region_line(id_: Column, city: Column, country: Column, start: Column, end: Column, dense: Column) -> Column:
    """One line that describes a region, with placeholders for what is unknown."""
    day = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit("?"))
    window = F.when(start.isNotNull() | end.isNotNull(), F.concat(F.lit("["), day(start), F.lit(" to "), day(end), F.lit("]")))
    return F.concat_ws(" ", id_.cast("string"), F.concat(F.coalesce(blank_to_null(city), F.lit("unknown city")), F.lit(", "), F.coalesce(blank_to_null(country), F.lit("unknown country"))), window, F.when(dense, "(dense)"))


def source_key(id_: Column, dense: Column, region: Column) -> Column:
    return F.when(dense, F.concat_ws("|", id_, F.lit("dense"), region.cast("string"))).otherwise(id_)


def source_id(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(1))


def in_window(moment_: Column, start: Column, end: Column) -> Column:
    """Whether a time is within bounds, each of which may be missing."""
    return (start.isNull() | (moment_ >= start)) & (end.isNull() | (moment_ <= end))


#: Suffixes of images in URLs, and suffixes by content type.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
SUFFIXES = {
    "image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/svg+xml": ".svg", "image/avif": ".avif", "image/heic": ".heic",
}


def image_suffix(url: Column, content_type: Column) -> Column:
    """Suffix of the URL's path if it is one of an image, else by content type, else .jpg."""
    found = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(\.[A-Za-z0-9]{1,5})$", 1))
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.coalesce(F.when(found.isin(*IMAGE_SUFFIXES), found), F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), kind), F.lit(".jpg"))


def safe_token(text: Column) -> Column:
    return F.translate(text, "/ ", "__")
