"""Queries of the schedule import as a whole: nine raw files to typed tables with item ids."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from ..operators import gtfs_import as G
from ..sources import readers as R
from ..steps import new_path, save
from .fixtures import run

QUERIES, SQL = {}, {}

#: The raw files, all text, with their rows in order of ``row_ord``.
RAW: dict[str, str] = {
    "agency": "SELECT CAST(c_custkey AS BIGINT) AS row_ord, CASE WHEN c_custkey % 97 = 5 THEN '' ELSE 'A' || CAST(c_custkey AS VARCHAR(20)) END AS agency_id, c_name AS agency_name, 'https://a.example' AS agency_url, 'UTC' AS agency_timezone FROM customer",
    "stops": "SELECT CAST(s_suppkey AS BIGINT) AS row_ord, 'S' || CAST(s_suppkey AS VARCHAR(20)) AS stop_id, s_name AS stop_name, CASE s_suppkey % 5 WHEN 2 THEN 'S' || CAST(s_suppkey + 1 AS VARCHAR(20)) WHEN 3 THEN 'X' || CAST(s_suppkey AS VARCHAR(20)) ELSE '' END AS parent_station, CAST(s_suppkey % 80 AS VARCHAR(20)) || '.25' AS stop_lat, '-' || CAST(s_suppkey % 90 AS VARCHAR(20)) || '.5' AS stop_lon, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '0' ELSE '4' END AS location_type FROM supplier",
    "routes": "SELECT CAST(p_partkey AS BIGINT) AS row_ord, 'R' || CAST(p_partkey AS VARCHAR(20)) AS route_id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'A' || CAST(p_partkey % 60 + 40 AS VARCHAR(20)) END AS agency_id, p_brand AS route_short_name, CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '3' ELSE '1100' END AS route_type, CASE WHEN p_partkey % 2 = 0 THEN 'ffaa0' || CAST(p_partkey % 10 AS VARCHAR(20)) ELSE '' END AS route_color FROM part",
    "trips": "SELECT CAST(o_orderkey AS BIGINT) AS row_ord, 'T' || CAST(o_orderkey AS VARCHAR(20)) AS trip_id, 'R' || CAST(o_custkey AS VARCHAR(20)) AS route_id, 'V' || CAST(o_orderkey % 9 AS VARCHAR(20)) AS service_id, o_orderpriority AS trip_headsign, CAST(o_orderkey % 2 AS VARCHAR(20)) AS direction_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'H' || CAST(o_orderkey % 22 AS VARCHAR(20)) END AS shape_id FROM orders",
    "stop_times": "SELECT CAST(l_orderkey AS BIGINT) AS row_ord, 'T' || CAST(l_orderkey AS VARCHAR(20)) AS trip_id, CASE WHEN l_partkey % 31 = 0 THEN '' ELSE 'S' || CAST(l_suppkey AS VARCHAR(20)) END AS stop_id, CAST(l_linenumber AS VARCHAR(20)) AS stop_sequence, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(20 + l_linenumber AS VARCHAR(20)) || ':05:30' END AS arrival_time, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(20 + l_linenumber AS VARCHAR(20)) || ':06:00' END AS departure_time, CAST(l_partkey % 4 AS VARCHAR(20)) AS pickup_type, CASE l_partkey % 3 WHEN 0 THEN '' ELSE CAST(l_partkey % 3 AS VARCHAR(20)) END AS drop_off_type, CASE l_suppkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '' END AS timepoint, CAST(l_linenumber AS VARCHAR(20)) || '.5' AS shape_dist_traveled FROM lineitem",
    "shapes": "SELECT CAST(p_partkey AS BIGINT) AS row_ord, 'H' || CAST(p_partkey % 25 AS VARCHAR(20)) AS shape_id, CAST(p_partkey % 80 AS VARCHAR(20)) || '.125' AS shape_pt_lat, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(p_partkey % 70 AS VARCHAR(20)) || '.75' END AS shape_pt_lon, CAST(p_partkey AS VARCHAR(20)) AS shape_pt_sequence, CAST(p_partkey AS VARCHAR(20)) || '.5' AS shape_dist_traveled FROM part",
    "calendar": "SELECT CAST(c_custkey AS BIGINT) AS row_ord, 'V' || CAST(c_custkey AS VARCHAR(20)) AS service_id, CAST(c_custkey % 2 AS VARCHAR(20)) AS monday, CAST(c_custkey % 3 AS VARCHAR(20)) AS tuesday, '1' AS wednesday, '0' AS thursday, '1' AS friday, '' AS saturday, '0' AS sunday, '20240101' AS start_date, '20241231' AS end_date FROM customer",
    "calendar_dates": "SELECT CAST(o_orderkey AS BIGINT) AS row_ord, 'V' || CAST(o_custkey + 7 AS VARCHAR(20)) AS service_id, '202405' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR(20)), 2, '0') AS date, CAST(o_orderkey % 2 + 1 AS VARCHAR(20)) AS exception_type FROM orders",
    "feed_info": "SELECT CAST(n_nationkey AS BIGINT) AS row_ord, n_name AS feed_publisher_name, 'https://f.example' AS feed_publisher_url, 'en' AS feed_lang, '' AS default_lang, '20240101' AS feed_start_date FROM nation",
}
_MENTIONED = (("agency", (("agency", "agency_id"),)), ("stops", (("stop", "stop_id"), ("stop", "parent_station"))), ("routes", (("route", "route_id"), ("agency", "agency_id"))),
              ("trips", (("trip", "trip_id"), ("route", "route_id"), ("service", "service_id"), ("shape", "shape_id"))), ("stop_times", (("trip", "trip_id"), ("stop", "stop_id"))),
              ("shapes", (("shape", "shape_id"),)), ("calendar", (("service", "service_id"),)), ("calendar_dates", (("service", "service_id"),)))
_ALL = " UNION ALL ".join(f"SELECT {k} AS s, row_ord AS o, {j} AS f, '{kind}' AS kind, nullif({column}, '') AS gtfs_id FROM ({RAW[name]}) t{k}{j}" for k, (name, refs) in enumerate(_MENTIONED) for j, (kind, column) in enumerate(refs))
#: Numbers in order of first mention; an agency without an id is a mention of its own.
IDS = f"""ids AS (SELECT kind, gtfs_id, CAST(row_number() OVER (ORDER BY first_at) AS INT) AS item_id FROM (SELECT kind, gtfs_id, min((s, o, f)) AS first_at FROM ({_ALL}) WHERE gtfs_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT kind, gtfs_id, (s, o, f) FROM ({_ALL}) WHERE gtfs_id IS NULL AND s = 0))"""


def of(kind: str, column: str, name: str) -> str:
    """The number of a reference, as a column of a raw row ``r``."""
    return f"(SELECT i.item_id FROM ids i WHERE i.kind = '{kind}' AND i.gtfs_id = nullif(r.{column}, '')) AS {name}"


def _imported(spark, sf):
    return G.import_version({name: run(spark, sf, sql) for name, sql in RAW.items()}, 3)


def query(sql: str, *columns: str, table: str):
    """Register the columns of one imported table."""
    name = f"imported_{table}"

    def read(spark, sf):
        return _imported(spark, sf)[table].select(*columns)

    read.__name__ = name
    QUERIES[name] = read
    SQL[name] = f"WITH {IDS} {sql}"


query(f"SELECT 3 AS version_id, {of('agency', 'agency_id', 'item_id')}, nullif(agency_id, '') AS gtfs_id, agency_name, agency_url, agency_timezone FROM ({RAW['agency']}) r",
      "version_id", "item_id", "gtfs_id", "agency_name", "agency_url", "agency_timezone", table="agency")
query(f"SELECT 3 AS version_id, {of('stop', 'stop_id', 'item_id')}, {of('stop', 'parent_station', 'parent_item_id')}, stop_name, CAST(stop_lat AS DOUBLE) AS stop_lat, CAST(stop_lon AS DOUBLE) AS stop_lon, CAST(coalesce(nullif(location_type, ''), '0') AS INT) AS location_type FROM ({RAW['stops']}) r",
      "version_id", "item_id", "parent_item_id", "stop_name", "stop_lat", "stop_lon", "location_type", table="stops")
query(f"SELECT 3 AS version_id, {of('route', 'route_id', 'item_id')}, {of('agency', 'agency_id', 'agency_item_id')}, route_short_name, CAST(route_type AS INT) AS route_type, upper(nullif(route_color, '')) AS route_color FROM ({RAW['routes']}) r",
      "version_id", "item_id", "agency_item_id", "route_short_name", "route_type", "route_color", table="routes")
query(f"SELECT 3 AS version_id, {of('trip', 'trip_id', 'item_id')}, {of('route', 'route_id', 'route_item_id')}, {of('service', 'service_id', 'service_item_id')}, {of('shape', 'shape_id', 'shape_item_id')}, trip_headsign, CAST(direction_id AS INT) AS direction_id FROM ({RAW['trips']}) r",
      "version_id", "item_id", "route_item_id", "service_item_id", "shape_item_id", "trip_headsign", "direction_id", table="trips")
_CLOCK = "CASE WHEN {0} <> '' THEN CAST(substr({0}, 1, 2) AS INT) * 3600 + {1} END"
_TIMES = f"""SELECT {of('trip', 'trip_id', 'trip_item_id')}, {of('stop', 'stop_id', 'stop_item_id')}, CAST(stop_sequence AS INT) AS stop_sequence, {_CLOCK.format('arrival_time', 330)} AS arrival_time, {_CLOCK.format('departure_time', 360)} AS departure_time,
CAST(pickup_type AS INT) AS pickup_type, CAST(coalesce(nullif(drop_off_type, ''), '0') AS INT) AS drop_off_type, CAST(coalesce(nullif(timepoint, ''), '1') AS INT) AS timepoint, CAST(shape_dist_traveled AS DOUBLE) AS shape_dist_traveled, row_ord FROM ({RAW['stop_times']}) r"""
_ARRAYS = ("stop_item_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "drop_off_type", "shape_dist_traveled", "timepoint")
query(f"SELECT 3 AS version_id, * EXCLUDE (row_ord) FROM ({_TIMES})", "version_id", "trip_item_id", *_ARRAYS, table="stop_times")


def imported_stop_times_seq(spark, sf):
    """All eight arrays of each trip."""
    text = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias(c)
    return _imported(spark, sf)["stop_times_seq"].select("version_id", "trip_item_id", *[text(f"{c}s") for c in _ARRAYS])


QUERIES["imported_stop_times_seq"] = imported_stop_times_seq
# Rows of one place in a file and one sequence, which a real file has not, are in the order of what they hold.
_PLACES = ", ".join(f"{c} NULLS FIRST" for c in ("stop_sequence", "row_ord", *(c for c in _ARRAYS if c != "stop_sequence")))
SQL["imported_stop_times_seq"] = f"WITH {IDS} SELECT 3 AS version_id, trip_item_id, " + ", ".join(f"string_agg(coalesce(CAST({c} AS VARCHAR), '-'), ',' ORDER BY {_PLACES}) AS {c}s" for c in _ARRAYS) + f" FROM ({_TIMES}) GROUP BY trip_item_id"
query(f"SELECT 3 AS version_id, {of('shape', 'shape_id', 'shape_item_id')}, CAST(shape_pt_lat AS DOUBLE) AS shape_pt_lat, CAST(nullif(shape_pt_lon, '') AS DOUBLE) AS shape_pt_lon, CAST(shape_pt_sequence AS INT) AS shape_pt_sequence FROM ({RAW['shapes']}) r",
      "version_id", "shape_item_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", table="shapes")
query(f"SELECT DISTINCT 3 AS version_id, {of('shape', 'shape_id', 'item_id')}, shape_id AS gtfs_id FROM ({RAW['shapes']}) r", "version_id", "item_id", "gtfs_id", table="shape_items")
query(f"SELECT 3 AS version_id, {of('service', 'service_id', 'service_item_id')}, monday = '1' AS monday, tuesday = '1' AS tuesday, TRUE AS wednesday, FALSE AS thursday, TRUE AS friday, FALSE AS saturday, FALSE AS sunday, start_date, end_date FROM ({RAW['calendar']}) r",
      "version_id", "service_item_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date", table="calendar")
query(f"SELECT 3 AS version_id, {of('service', 'service_id', 'service_item_id')}, date, CAST(exception_type AS INT) AS exception_type FROM ({RAW['calendar_dates']}) r",
      "version_id", "service_item_id", "date", "exception_type", table="calendar_dates")
query(f"SELECT 3 AS version_id, feed_publisher_name AS publisher_name, feed_publisher_url AS publisher_url, feed_lang AS lang, CAST(NULL AS VARCHAR) AS default_lang, feed_start_date AS start_date FROM ({RAW['feed_info']}) r",
      "version_id", "publisher_name", "publisher_url", "lang", "default_lang", "start_date", table="feed_info")


def imported_shape_lines(spark, sf):
    d = _imported(spark, sf)["shapes_seq"]
    text = lambda c, f=lambda x: x: F.array_join(F.transform(c, lambda x: f(x).cast("string")), ",")
    return d.select("shape_item_id", F.col("n_points").cast("long").alias("n_points"), text("line", lambda p: p["lon"]).alias("lons"), text("sequences").alias("sequences"), text("distances").alias("distances"))


QUERIES["imported_shape_lines"] = imported_shape_lines
SQL["imported_shape_lines"] = f"""WITH {IDS} SELECT shape_item_id, count(*) AS n_points, CASE WHEN count(lon) >= 2 THEN string_agg(lon, ',' ORDER BY n) END AS lons, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS sequences, string_agg(dist, ',' ORDER BY n) AS distances
FROM (SELECT {of('shape', 'shape_id', 'shape_item_id')}, CAST(shape_pt_sequence AS INT) AS n, nullif(shape_pt_lon, '') AS lon, shape_dist_traveled AS dist FROM ({RAW['shapes']}) r) GROUP BY 1"""


def imported_files(spark, sf):
    """Rows of each table after an import from files of which one optional one, feed_info.txt, is absent."""
    root, paths = new_path(spark), {}
    for name, sql in RAW.items():
        if name != "feed_info":
            paths[name] = posixpath.join(root, f"{name}.txt")
            run(spark, sf, sql).drop("row_ord").write.option("header", True).csv(paths[name])
    tables = G.import_version(R.read_feed(spark, paths), 3)
    out = None
    for name in (*RAW, "shape_items", "stop_times_seq", "shapes_seq"):
        own = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


QUERIES["imported_files"] = imported_files
SQL["imported_files"] = " UNION ALL ".join(
    [f"SELECT '{name}' AS table_name, {'count(*) FILTER (WHERE FALSE)' if name == 'feed_info' else 'count(*)'} AS n FROM ({sql}) {name[:4]}" for name, sql in RAW.items()]
    + [f"SELECT '{name}', count(DISTINCT {column}) FROM ({RAW[table]}) {name[:2]}" for name, column, table in (("shape_items", "shape_id", "shapes"), ("stop_times_seq", "trip_id", "stop_times"), ("shapes_seq", "shape_id", "shapes"))])
