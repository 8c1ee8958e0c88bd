"""Street-level tables as views over the driver's star-schema tables.

Each view is one SELECT in words that Spark SQL and DuckDB read alike; {name} is a table or an
earlier view. Spark gets DataFrames in the places, DuckDB gets a WITH clause.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LABELS = ("barrier", "billboard", "bin", "graffiti", "mobile_advertisement", "pothole", "road_sign", "shop_sign", "utility_pole", "other")
_WHICH = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS))

VIEWS = {
    "regions": """
SELECT CAST(n_nationkey AS BIGINT) AS region_id, concat('Region_', CAST(n_nationkey AS STRING)) AS name, n_name AS city, r_name AS country,
 concat('R0', CAST(r_regionkey AS STRING)) AS iso3,
 CAST((n_nationkey % 5) * 10 AS DOUBLE) AS min_lng, CAST((n_nationkey % 5) * 10 + 10 AS DOUBLE) AS max_lng,
 CAST((n_nationkey - n_nationkey % 5) * 2 AS DOUBLE) AS min_lat, CAST((n_nationkey - n_nationkey % 5) * 2 + 10 AS DOUBLE) AS max_lat,
 CASE WHEN n_nationkey % 10 = 9 THEN NULL ELSE (n_nationkey + 1) * 37000 END AS population,
 n_nationkey % 8 = 7 AS dense_scan,
 CASE WHEN n_nationkey % 6 = 5 THEN CAST('2020-01-01 00:00:00' AS TIMESTAMP) END AS start_captured_at,
 CAST(NULL AS TIMESTAMP) AS end_captured_at
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "images": """
SELECT o_orderkey AS image_id, CAST(c_nationkey AS BIGINT) AS region_id, CAST(o_orderkey AS STRING) AS id_from_source,
 g.min_lng + CAST((37 * o_orderkey) % 1000 AS DOUBLE) / 100 AS lng, g.min_lat + CAST((91 * o_orderkey) % 1000 AS DOUBLE) / 100 AS lat,
 CASE WHEN o_orderstatus = 'O' THEN 'kartaview' ELSE 'mapillary' END AS source,
 CASE WHEN o_orderstatus = 'P' THEN 'unreviewed' ELSE 'reviewed' END AS status,
 CAST(o_orderdate AS TIMESTAMP) AS source_captured_at, concat('https://img.test/', CAST(o_orderkey AS STRING), '.jpg') AS url,
 1024 AS width, 768 AS height, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS url_fetched_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {regions} g ON g.region_id = c_nationkey""",
    "detections": f"""
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS detection_id,
 l_orderkey AS image_id, CASE CAST(least(l_partkey % 10, region_id % 10) AS INT) {_WHICH} END AS label,
 round(0.39e0 + 6 * l_discount, 4) AS confidence,
 concat('[', CAST(CAST(l_quantity AS BIGINT) AS STRING), ',', CAST(10 * l_linenumber AS STRING), ',', CAST(CAST(l_quantity AS BIGINT) + 20 * l_linenumber AS STRING), ',', CAST(10 * l_linenumber + 30 AS STRING), ']') AS bbox,
 CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS manual_reviewed
FROM {{lineitem}} JOIN {{images}} ON image_id = l_orderkey""",
    "osm_features": """
SELECT event_id AS feature_id, user_id % 25 AS region_id, CAST(event_id AS STRING) AS osm_id,
 CASE event_type WHEN 'click' THEN 'power' WHEN 'view' THEN 'bin' WHEN 'purchase' THEN 'billboard' WHEN 'signup' THEN 'barrier' ELSE 'unlisted' END AS osm_type,
 g.min_lng + CAST((53 * event_id) % 1000 AS DOUBLE) / 100 AS lng, g.min_lat + CAST((71 * event_id) % 1000 AS DOUBLE) / 100 AS lat
FROM {events} JOIN {regions} g ON g.region_id = user_id % 25""",
    "landuse_polygons": """
SELECT p_partkey AS poly_id, CAST(p_partkey % 25 AS BIGINT) AS region_id,
 CASE WHEN p_type LIKE 'ECONOMY%' THEN 'commercial' WHEN p_type LIKE 'PROMO%' THEN 'retail' WHEN p_type LIKE 'LARGE%' THEN 'industrial' WHEN p_type LIKE 'MEDIUM%' THEN 'residential' WHEN p_type LIKE 'STANDARD%' THEN 'mixed_use' END AS landuse,
 CASE WHEN p_type LIKE 'SMALL%' THEN 'park' END AS leisure,
 g.min_lng + CAST((53 * p_partkey) % 900 AS DOUBLE) / 100 AS x0, g.min_lat + CAST((29 * p_partkey) % 900 AS DOUBLE) / 100 AS y0, CAST(p_size AS DOUBLE) / 20 AS side
FROM {part} JOIN {regions} g ON g.region_id = p_partkey % 25""",
}
_PLACES = re.compile(r"\{(\w+)\}")


class Views:
    """views.name: a driver table or a view of VIEWS, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                needed = {x: getattr(self, x) for x in _PLACES.findall(VIEWS[name])}
                self._made[name] = self._spark.sql(VIEWS[name], **needed)
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def oracle(sql: str) -> str:
    """DuckDB SQL over {view} places: a WITH clause of the views it needs, in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for x in _PLACES.findall(text):
            if x in VIEWS and x not in needed:
                need(VIEWS[x])
                needed.append(x)

    need(sql)
    plain = lambda text: _PLACES.sub(r"\1", text)
    views = ", ".join(f"{x} AS MATERIALIZED ({plain(VIEWS[x])})" for x in needed)
    own = plain(sql).strip()
    return f"WITH {views}, {own[4:].strip()}" if views and own.upper().startswith("WITH") else f"WITH {views} {own}" if views else own
