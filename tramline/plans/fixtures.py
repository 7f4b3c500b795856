"""Derived views over the driver tables: schedule, map and raster data that grow with them. Portable SQL, the same for every engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "fx_versions": r"""
SELECT DISTINCT CAST(r_regionkey % 2 + 1 AS INT) AS version_id FROM region
""",
    "fx_stops": r"""
SELECT v.version_id,
       CAST(s_suppkey + 1 AS INT) AS item_id,
       'S' || CAST(s_suppkey AS STRING) AS item_gtfs_id,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS stop_name,
       CASE WHEN s_suppkey % 4 = 0 THEN 'C' || CAST(s_suppkey AS STRING) END AS stop_code,
       CASE WHEN s_suppkey % 23 = 22 THEN NULL WHEN s_suppkey % 17 = 16 THEN 89e0
            ELSE 35e0 + ((s_suppkey * 53) % 250) / 1e1 END AS stop_lat,
       CASE WHEN s_suppkey % 23 = 22 THEN NULL ELSE -10e0 + ((s_suppkey * 37) % 400) / 1e1 END AS stop_lon,
       CAST(CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 4 THEN 4 ELSE 0 END AS INT) AS location_type,
       CAST(CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 4 THEN s_suppkey ELSE s_suppkey - s_suppkey % 5 + 1 END AS INT) AS parent_station_item_id,
       CASE WHEN s_suppkey % 6 = 1 THEN 'Near ' || s_name END AS stop_desc,
       CAST(CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 4 END AS INT) AS wheelchair_boarding,
       CASE WHEN s_suppkey % 3 = 1 THEN 'P' || CAST(s_suppkey % 12 AS STRING) END AS platform_code
FROM supplier CROSS JOIN fx_versions v
""",
    "fx_routes": r"""
SELECT v.version_id,
       CAST(p_partkey + 1 AS INT) AS item_id,
       'R' || CAST(p_partkey AS STRING) AS item_gtfs_id,
       CAST(p_partkey % 5 + 1 AS INT) AS agency_item_id,
       p_brand AS route_short_name,
       p_name AS route_long_name,
       CAST(CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1100 ELSE NULL END AS INT) AS route_type,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'FF00AA' END AS route_color
FROM part CROSS JOIN fx_versions v
WHERE p_partkey % 37 <> 0
""",
    "fx_trips": r"""
SELECT CAST(o_orderkey % 2 + 1 AS INT) AS version_id,
       CAST(o_orderkey + 1 AS INT) AS item_id,
       'T' || CAST(o_orderkey AS STRING) AS item_gtfs_id,
       CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey + 1 END AS INT) AS route_item_id,
       CAST(o_orderkey % 9 + 1 AS INT) AS service_item_id,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 22 + 1 END AS INT) AS shape_item_id
FROM orders
""",
    "fx_stop_times": r"""
SELECT CAST(l_orderkey % 2 + 1 AS INT) AS version_id,
       CAST(l_orderkey + 1 AS INT) AS trip_item_id,
       CAST(CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE l_suppkey + 1 END AS INT) AS stop_item_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS stop_sequence,
       CAST(21600 + l_linenumber * 180 AS INT) AS arrival_time,
       CAST(CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 21630 + l_linenumber * 180 END AS INT) AS departure_time
FROM lineitem
""",
    "fx_shape_points": r"""
SELECT v.version_id,
       CAST(p_partkey % 20 + 1 AS INT) AS shape_item_id,
       CAST(row_number() OVER (PARTITION BY v.version_id, p_partkey % 20 ORDER BY p_partkey) AS INT) AS shape_pt_sequence,
       CASE WHEN p_partkey % 20 = 7 THEN 50e0 WHEN p_partkey % 37 = 0 THEN NULL ELSE 45e0 + (p_partkey % 20) / 1e1 + p_partkey / 1e4 END AS shape_pt_lat,
       CASE WHEN p_partkey % 20 = 7 THEN 10e0 WHEN p_partkey % 37 = 0 THEN NULL ELSE 5e0 + (p_partkey % 20) / 1e1 + p_partkey / 2e3 END AS shape_pt_lon
FROM part CROSS JOIN fx_versions v
""",
    "fx_osm_tags": r"""
SELECT CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END AS osm_type, p_partkey AS osm_key, 'amenity' AS k,
       CASE p_partkey % 5 WHEN 0 THEN 'fast_food' WHEN 1 THEN 'bank' WHEN 2 THEN 'bench' WHEN 3 THEN 'not_listed' ELSE ' ' END AS v
FROM part WHERE p_partkey % 4 <> 0
UNION ALL
SELECT CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END, p_partkey, 'source', 'survey' FROM part
UNION ALL
SELECT CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END, p_partkey, 'addr:street', p_name FROM part WHERE p_partkey % 2 = 1
UNION ALL
SELECT CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'W' ELSE 'R' END, p_partkey, 'addr:housenumber', CAST(p_size AS STRING) FROM part WHERE p_partkey % 6 = 1
""",
    "fx_boxes": r"""
SELECT CAST(c_custkey AS BIGINT) AS feature_id,
       CASE c_custkey % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'lanes' ELSE 'intersection_markings' END AS layer,
       c_mktsegment AS class,
       13e0 + ((c_custkey * 29) % 700) / 1e3 AS west,
       52e0 + ((c_custkey * 41) % 700) / 1e3 AS south,
       13e0 + ((c_custkey * 29) % 700) / 1e3 + (c_custkey % 7) / 1e3 AS east,
       52e0 + ((c_custkey * 41) % 700) / 1e3 + (c_custkey % 5) / 1e3 AS north
FROM customer
""",
    "fx_segments": r"""
SELECT CAST(s_suppkey AS INT) AS segment_id,
       ((s_suppkey * 37) % 101) / 1.01e2 AS ax, ((s_suppkey * 53) % 101) / 1.01e2 AS ay,
       ((s_suppkey * 37 + 11) % 101) / 1.01e2 AS bx, ((s_suppkey * 53 + 7) % 101) / 1.01e2 AS by_
FROM supplier
""",
    "fx_frames": r"""
SELECT user_id, event_id, ts AS ended_at, value AS duration_ms FROM events
""",
}


# Larger relatives of the views above, for work that is to grow with the tables.
VIEWS |= {
    "dx_versions": """SELECT CAST(o_orderkey + 1 AS INT) AS id, CAST(o_custkey + 1 AS BIGINT) AS source_id, md5(CAST(o_orderkey % 50 AS VARCHAR(20))) AS content_hash,
       CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'imported' WHEN 2 THEN 'downloaded' ELSE 'import_failed' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST((o_orderkey * 7) % 11 AS INT) AS fetched_at,
       CASE WHEN o_orderkey % 3 = 0 THEN 'etag-' || CAST(o_orderkey AS VARCHAR(20)) END AS http_etag
FROM orders""",
    "dx_sources": """SELECT CAST(c_custkey + 1 AS BIGINT) AS id, 'feed-' || CAST(c_custkey AS VARCHAR(20)) AS slug, c_name AS name, 'https://feeds.example/' || CAST(c_custkey AS VARCHAR(20)) || '.zip' AS direct_download_url, a.active_version_id
FROM customer LEFT JOIN (SELECT source_id, min(id) AS active_version_id FROM dx_versions WHERE status = 'active' GROUP BY source_id) a ON a.source_id = c_custkey + 1""",
    "dx_bands": """SELECT CAST(floor(p_partkey / 576e0) AS INT) AS tile_id, b.band, CAST(floor((p_partkey % 576) / 24e0) AS INT) AS row_no, CAST(p_partkey % 24 AS INT) AS col_no,
       CAST(CASE WHEN p_partkey % 41 = 0 THEN -32768 ELSE (p_partkey * 211 + b.band * 1301) % 6000 - 50 END AS INT) AS dn
FROM part CROSS JOIN (SELECT 0 AS band UNION ALL SELECT 1 UNION ALL SELECT 2) b
WHERE p_partkey < (SELECT floor(count(*) / 576e0) * 576 FROM part)""",
    "dx_px": """SELECT tile_id, row_no, col_no, CAST((row_no * 37 + col_no * 11 + tile_id * 5) % 256 AS INT) AS r, CAST((row_no * 5 + col_no * 3) % 256 AS INT) AS g, CAST((col_no * 9) % 256 AS INT) AS b, CAST(CASE WHEN (row_no + col_no) % 7 = 0 THEN 0 ELSE 255 END AS INT) AS a
FROM dx_bands WHERE band = 0""",
}


def needed(sql: str) -> list[str]:
    """The views that ``sql`` names, with those that they name, in order of definition."""
    found = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while more := {w for v in found for w in VIEWS if w not in found and re.search(rf"\b{w}\b", VIEWS[v])}:
        found |= more
    return [v for v in VIEWS if v in found]


def whole(sql: str) -> str:
    """``sql`` with the views it names written out before it."""
    views = needed(sql)
    if not views:
        return sql
    body = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in views)
    rest = sql.strip()
    if rest[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {body},\n{rest[14:]}"
    return f"WITH {body},\n{rest[4:]}" if rest[:4].upper() == "WITH" else f"WITH {body}\n{rest}"


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Portable SQL over the driver tables and the derived views."""
    sql = whole(sql)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    return run(spark, sf_dir, f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
