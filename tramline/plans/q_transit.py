"""Queries of schedule import, schedule queries and tiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gtfs_import as G
from ..operators import tiling as L
from ..operators import transit as Q
from .fixtures import fx, whole
from .q_spatial import X, Y

CTE: dict[str, str] = {
    "refs": "SELECT DISTINCT s.version_id, s.stop_item_id, t.route_item_id FROM fx_stop_times s JOIN fx_trips t ON t.version_id = s.version_id AND t.item_id = s.trip_item_id WHERE s.stop_item_id IS NOT NULL AND t.route_item_id IS NOT NULL",
    "agg": "SELECT s.version_id, s.item_id AS stop_item_id, coalesce((list_sort(list(DISTINCT r.route_item_id) FILTER (WHERE r.route_item_id IS NOT NULL))), []) AS route_item_ids FROM fx_stops s LEFT JOIN fx_stops c ON c.version_id = s.version_id AND (c.item_id = s.item_id OR c.parent_station_item_id = s.item_id) LEFT JOIN refs r ON r.version_id = s.version_id AND r.stop_item_id = c.item_id GROUP BY 1, 2",
    "seqs": "SELECT version_id, trip_item_id, list(stop_item_id ORDER BY stop_sequence) AS stop_item_ids, list(arrival_time ORDER BY stop_sequence) AS arrival_times, list(departure_time ORDER BY stop_sequence) AS departure_times FROM fx_stop_times GROUP BY 1, 2",
    "shapes": "SELECT version_id, shape_item_id, count(*) AS n_points, count(*) FILTER (WHERE shape_pt_lon IS NOT NULL AND shape_pt_lat IS NOT NULL) AS n_good, count(DISTINCT (shape_pt_lon, shape_pt_lat)) FILTER (WHERE shape_pt_lon IS NOT NULL AND shape_pt_lat IS NOT NULL) AS n_distinct FROM fx_shape_points GROUP BY 1, 2",
    "tree": "SELECT version_id, item_id AS root_id, item_id AS stop_id, parent_station_item_id AS parent_id, 0 AS depth, [item_id] AS path FROM fx_stops UNION ALL SELECT t.version_id, t.root_id, s.item_id, s.parent_station_item_id, t.depth + 1, list_append(t.path, s.item_id) FROM tree t JOIN fx_stops s ON s.version_id = t.version_id AND s.parent_station_item_id = t.stop_id WHERE NOT list_contains(t.path, s.item_id)",
    "points": "SELECT * FROM fx_stops WHERE stop_lon BETWEEN -180 AND 180 AND stop_lat BETWEEN -85.05112878 AND 85.05112878",
    "summary": "SELECT a.version_id, a.stop_item_id, len(any_value(a.route_item_ids)) AS route_count, coalesce(string_agg(DISTINCT CAST(r.route_type AS VARCHAR), ',' ORDER BY CAST(r.route_type AS VARCHAR)), '') AS route_types FROM agg a LEFT JOIN (SELECT version_id, stop_item_id, unnest(route_item_ids) AS route_item_id FROM agg) e ON e.version_id = a.version_id AND e.stop_item_id = a.stop_item_id LEFT JOIN fx_routes r ON r.version_id = e.version_id AND r.item_id = e.route_item_id GROUP BY 1, 2",
    "candidates": "SELECT t.version_id, t.item_id AS trip_item_id, t.route_item_id, q.stop_item_ids FROM fx_trips t JOIN seqs q ON q.version_id = t.version_id AND q.trip_item_id = t.item_id WHERE t.route_item_id IS NOT NULL AND t.shape_item_id IS NULL AND len(q.stop_item_ids) >= 2",
    "features": "SELECT version_id, route_item_id, stop_item_ids, min(trip_item_id) AS trip_item_id FROM candidates GROUP BY 1, 2, 3",
    "lines": "SELECT e.version_id, e.route_item_id, e.trip_item_id, count(*) AS n, sum(p.stop_lon) AS lon_sum, arg_min(p.stop_lon, e.pos) AS first_lon FROM (SELECT version_id, route_item_id, trip_item_id, unnest(stop_item_ids) AS stop, generate_subscripts(stop_item_ids, 1) AS pos FROM features) e JOIN points p ON p.version_id = e.version_id AND p.item_id = e.stop GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND (min(p.stop_lon) <> max(p.stop_lon) OR min(p.stop_lat) <> max(p.stop_lat))",
    "shaped": "SELECT DISTINCT t.version_id, t.route_item_id, t.shape_item_id FROM fx_trips t JOIN shapes s ON s.version_id = t.version_id AND s.shape_item_id = t.shape_item_id WHERE t.route_item_id IS NOT NULL AND s.n_good >= 2 AND s.n_distinct >= 2",
    "located": f"SELECT *, {X('stop_lon', 13)} AS x0, {Y('stop_lat', 13)} AS y0 FROM points",
    "placed": "SELECT * FROM (SELECT l.*, l.x0 - dx AS x, l.y0 - dy AS y FROM located l, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy) WHERE (dx = 0 OR stop_lon = x0 / 8192e0 * 360e0 - 180e0) AND (dy = 0 OR stop_lat = degrees(atan(sinh(pi() * (1e0 - 2e0 * y0 / 8192e0)))))) WHERE x >= 0 AND y >= 0",
}


def with_ctes(sql: str) -> str:
    import re

    found: list[str] = []

    def need(text):
        for name in CTE:
            if name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                if name != "tree":
                    need(CTE[name])
                found.append(name)

    need(sql)
    body = ",\n".join(f"{n}{'' if n != 'tree' else ''} AS ({CTE[n]})" for n in found)
    rec = "RECURSIVE " if "tree" in found else ""
    return whole(f"WITH {rec}{body}\n{sql}" if found else sql)


def stops_(spark, sf):
    return fx(spark, sf, "fx_stops")


def refs_(spark, sf):
    return G.stop_route_refs(fx(spark, sf, "fx_stop_times"), fx(spark, sf, "fx_trips"))


def agg_(spark, sf):
    return G.stop_route_agg(stops_(spark, sf), refs_(spark, sf))


def shapes_(spark, sf):
    return G.shapes_seq(fx(spark, sf, "fx_shape_points"))


def seqs_(spark, sf):
    return G.stop_times_seq(fx(spark, sf, "fx_stop_times"), ["stop_item_id", "arrival_time", "departure_time"])


def tree_(spark, sf):
    return Q.stop_tree(stops_(spark, sf), agg_(spark, sf))


def features_(spark, sf):
    s = stops_(spark, sf)
    tilings = L.selected_tilings(fx(spark, sf, "fx_versions").withColumn("source_id", F.col("version_id").cast("long") + 6), fx(spark, sf, "dx_sources"))
    return L.tile_features(L.stop_points(s), agg_(spark, sf), fx(spark, sf, "fx_routes"), s, tilings)


QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_ctes(sql)
        return f

    return add


FEATURES = """SELECT p.version_id, 13 AS z, p.x, p.y, d.feature_id, o.slug AS source_slug, p.item_id AS stop_item_id, p.item_gtfs_id AS stop_id, coalesce(p.stop_code, '') AS stop_code, coalesce(p.stop_name, '') AS stop_name, coalesce(p.stop_desc, '') AS stop_desc,
  coalesce(u.item_gtfs_id, '') AS parent_station_id, p.location_type, coalesce(p.wheelchair_boarding, 0) AS wheelchair_boarding, coalesce(p.platform_code, '') AS platform_code, s.route_types, CAST(s.route_count AS INT) AS route_count,
  CAST(floor(((p.stop_lon + 180e0) / 360e0 * 8192e0 - p.x) * 4096 + 0.5e0) AS INT) AS px,
  CAST(floor(((1e0 - ln(tan(radians(p.stop_lat)) + 1e0 / cos(radians(p.stop_lat))) / pi()) / 2e0 * 8192e0 - p.y) * 4096 + 0.5e0) AS INT) AS py
FROM placed p JOIN (SELECT version_id, item_id, row_number() OVER (PARTITION BY version_id ORDER BY item_id) AS feature_id FROM points) d ON d.version_id = p.version_id AND d.item_id = p.item_id JOIN dx_sources o ON o.id = p.version_id + 6
LEFT JOIN summary s ON s.version_id = p.version_id AND s.stop_item_id = p.item_id LEFT JOIN fx_stops u ON u.version_id = p.version_id AND u.item_id = p.parent_station_item_id"""


@query(FEATURES)
def tile_stops_with_routes(spark, sf):
    return features_(spark, sf)


@query(f"SELECT *, count(*) OVER (PARTITION BY version_id, z, x, y) AS n_features FROM ({FEATURES})")
def tiles_assembled(spark, sf):
    """What stands in the payload of each tile."""
    t = L.tiles(features_(spark, sf))
    kinds = {f: "long" if f == "feature_id" else "int" for f in ("feature_id", "stop_item_id", "location_type", "wheelchair_boarding", "route_count", "px", "py")}
    schema = ", ".join(f"{f}: {kinds.get(f, 'string')}" for f in (*L.ATTRIBUTES, "px", "py"))
    return t.select("version_id", "z", "x", "y", "n_features", F.inline(F.from_json("payload", f"array<struct<{schema}>>")))


@query(f"SELECT x >> 6 AS chunk_x, y >> 6 AS chunk_y, count(*) AS n_tiles, CAST((y >> 6) * 128 + (x >> 6) + 1 AS BIGINT) AS progress, CAST(16384 AS BIGINT) AS \"of\" FROM (SELECT DISTINCT x, y FROM ({FEATURES})) GROUP BY 1, 2, 4")
def export_progress(spark, sf):
    return L.export_totals(L.occupied_tiles(L.stop_points(stops_(spark, sf)), 13))


@query(f"""SELECT version_id, stop_item_id, x, y, parent_station_id = '' AND location_type IN (0, 1) AND route_types IN ('0','1','2','3','4','5','6','7','11','12','200','1100','1500') AS root,
CASE location_type WHEN 1 THEN 'station' WHEN 2 THEN 'entrance_exit' WHEN 3 THEN 'generic_node' WHEN 4 THEN 'boarding_area' ELSE CASE WHEN platform_code <> '' THEN 'platform' WHEN stop_code <> '' THEN 'stop' ELSE 'unknown' END END AS symbol FROM ({FEATURES})""")
def stop_symbols(spark, sf):
    d = features_(spark, sf)
    return d.select("version_id", "stop_item_id", "x", "y", L.is_root_stop().alias("root"), L.stop_symbol().alias("symbol"))


@query("SELECT version_id, stop_item_id, route_item_id FROM refs")
def stop_route_refs(spark, sf):
    return refs_(spark, sf)


@query("SELECT version_id, stop_item_id, list_transform(route_item_ids, lambda r: CAST(r AS VARCHAR)).list_aggregate('string_agg', ',') AS routes, CAST(len(route_item_ids) AS INT) AS n FROM agg")
def stop_route_agg(spark, sf):
    d = agg_(spark, sf)
    return d.select("version_id", "stop_item_id", F.nullif(F.array_join(F.col("route_item_ids").cast("array<string>"), ","), F.lit("")).alias("routes"), F.size("route_item_ids").alias("n"))


@query("""SELECT version_id, trip_item_id, array_to_string(list_transform(stop_item_ids, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ',') AS stops,
array_to_string(list_transform(arrival_times, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ',') AS arrivals, array_to_string(list_transform(departure_times, lambda v: coalesce(CAST(v AS VARCHAR), '-')), ',') AS departures FROM seqs""")
def stop_times_packed(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    return seqs_(spark, sf).select("version_id", "trip_item_id", text("stop_item_ids").alias("stops"), text("arrival_times").alias("arrivals"), text("departure_times").alias("departures"))


@query("SELECT version_id, shape_item_id, CAST(n_points AS INT) AS n_points, CAST(CASE WHEN n_good >= 2 THEN n_good END AS INT) AS n_line, n_good >= 2 AND n_distinct >= 2 AS valid FROM shapes")
def shapes_packed(spark, sf):
    d = shapes_(spark, sf)
    ok = L.valid_shapes(d).select("version_id", "shape_item_id", F.lit(True).alias("ok"))
    return d.join(ok, ["version_id", "shape_item_id"], "left").select("version_id", "shape_item_id", "n_points", F.when(F.col("line").isNotNull(), F.size("line")).alias("n_line"), F.coalesce("ok", F.lit(False)).alias("valid"))


@query("""SELECT t.version_id, t.root_id, t.stop_id, t.parent_id, t.depth, array_to_string(t.path, '/') AS path, CAST(len(a.route_item_ids) AS INT) AS n_routes,
row_number() OVER (PARTITION BY t.version_id, t.root_id ORDER BY t.depth, t.stop_id) AS place FROM tree t LEFT JOIN agg a ON a.version_id = t.version_id AND a.stop_item_id = t.stop_id""")
def stop_trees(spark, sf):
    d = Q.flatten_tree(tree_(spark, sf))
    return d.select("version_id", "root_id", "stop_id", "parent_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("route_item_ids").alias("n_routes"), "place")


@query("""SELECT version_id, root_id, coalesce(string_agg(r, ',' ORDER BY r), '') AS routes FROM (SELECT DISTINCT t.version_id, t.root_id, u.r FROM tree t LEFT JOIN (SELECT version_id, stop_item_id, unnest(route_item_ids) AS r FROM agg) u ON u.version_id = t.version_id AND u.stop_item_id = t.stop_id) GROUP BY 1, 2""")
def tree_route_ids(spark, sf):
    d = Q.tree_route_ids(tree_(spark, sf))
    return d.select("version_id", "root_id", F.array_join(F.col("route_item_ids").cast("array<string>"), ",").alias("routes"))


@query("""SELECT version_id, root_id, CAST(sum(1) AS BIGINT) AS n_stops, CAST(max(depth) AS INT) AS height FROM tree GROUP BY 1, 2""")
def nested_stops(spark, sf):
    d = Q.nest_stops(tree_(spark, sf))
    shut = F.regexp_count("json", F.lit(r'"stop":')).cast("long")
    # Height: how deep the children arrays go, from the brackets before each stop.
    opened = F.aggregate(F.filter(F.split("json", ""), lambda c: c.isin("{", "}")), F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, c: F.struct((a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("d"), F.greatest(a["m"], a["d"] + F.when(c == "{", 1).otherwise(-1)).alias("m")), lambda a: a["m"] - 1)
    return d.select("version_id", "root_id", shut.alias("n_stops"), opened.alias("height"))


@query("SELECT a.version_id, a.stop_item_id, a.route_item_id, s.shape_item_id, '#' || r.route_color AS color FROM (SELECT version_id, stop_item_id, unnest(route_item_ids) AS route_item_id FROM agg) a JOIN shaped s ON s.version_id = a.version_id AND s.route_item_id = a.route_item_id JOIN fx_routes r ON r.version_id = a.version_id AND r.item_id = a.route_item_id")
def stop_trip_lines(spark, sf):
    lines = L.shape_lines(fx(spark, sf, "fx_trips"), shapes_(spark, sf)).withColumn("feature_id", F.col("shape_item_id"))
    return Q.stop_trip_lines(agg_(spark, sf), lines, fx(spark, sf, "fx_routes")).select("version_id", "stop_item_id", "route_item_id", F.col("feature_id").alias("shape_item_id"), "color")


AGENCY = "SELECT DISTINCT version_id, agency_item_id, 'Agency ' || CAST(agency_item_id AS VARCHAR) AS agency_name FROM fx_routes WHERE agency_item_id <> 3"


@query(f"SELECT r.version_id, r.item_id, a.agency_name, CASE WHEN r.route_short_name <> '' AND r.route_long_name <> '' THEN r.route_short_name || ' - ' || r.route_long_name ELSE coalesce(nullif(r.route_short_name, ''), nullif(r.route_long_name, ''), r.item_gtfs_id) END AS title FROM fx_routes r LEFT JOIN ({AGENCY}) a USING (version_id, agency_item_id)")
def route_details(spark, sf):
    r = fx(spark, sf, "fx_routes")
    agency = r.filter("agency_item_id <> 3").select("version_id", "agency_item_id", F.concat(F.lit("Agency "), F.col("agency_item_id").cast("string")).alias("agency_name")).distinct()
    return Q.route_details(r, agency).select("version_id", "item_id", "agency_name", Q.route_title("route_short_name", "route_long_name", "item_gtfs_id").alias("title"))


ICON = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.CATEGORIES.items()) + " END"


@query(f"SELECT version_id, stop_item_id, CASE WHEN count(DISTINCT c) = 1 THEN min(c) ELSE 'route' END AS category FROM (SELECT version_id, stop_item_id, {ICON} AS c FROM (SELECT version_id, stop_item_id, unnest(string_split(route_types, ',')) AS t FROM summary)) GROUP BY 1, 2")
def station_categories(spark, sf):
    return Q.station_category(L.route_summary(agg_(spark, sf), fx(spark, sf, "fx_routes")), ["version_id", "stop_item_id"], "route_types")


@query("SELECT version_id, item_id, coalesce(nullif(stop_name, ''), nullif(platform_code, ''), nullif(stop_code, ''), item_gtfs_id) AS title FROM fx_stops")
def stop_titles(spark, sf):
    return stops_(spark, sf).select("version_id", "item_id", Q.stop_title("stop_name", "platform_code", "stop_code", "item_gtfs_id").alias("title"))


@query("SELECT version_id, item_id, k AS key, coalesce(v, '') AS value FROM (SELECT version_id, item_id, unnest(['item_gtfs_id', 'stop_name', 'stop_code', 'location_type', 'stop_desc', 'wheelchair_boarding', 'platform_code']) AS k, unnest([item_gtfs_id, stop_name, stop_code, CAST(location_type AS VARCHAR), stop_desc, CAST(wheelchair_boarding AS VARCHAR), platform_code]) AS v FROM fx_stops)")
def stop_records(spark, sf):
    return Q.record_rows(stops_(spark, sf).drop("stop_lat", "stop_lon", "parent_station_item_id"), ["version_id", "item_id"])


@query("SELECT version_id, route_item_id, shape_item_id FROM shaped")
def shape_lines(spark, sf):
    return L.shape_lines(fx(spark, sf, "fx_trips"), shapes_(spark, sf)).select("version_id", "route_item_id", "shape_item_id")


@query("SELECT t.version_id, t.item_id AS trip_item_id, t.route_item_id, t.shape_item_id FROM fx_trips t SEMI JOIN shaped s ON s.version_id = t.version_id AND s.route_item_id = t.route_item_id AND s.shape_item_id = t.shape_item_id")
def shape_line_refs(spark, sf):
    t = fx(spark, sf, "fx_trips")
    return L.shape_line_refs(t, L.shape_lines(t, shapes_(spark, sf))).select("version_id", "trip_item_id", "route_item_id", "shape_item_id")


def _sequences(spark, sf):
    c = L.sequence_candidates(fx(spark, sf, "fx_trips"), seqs_(spark, sf))
    f = L.sequence_features(c)
    return c, f, L.sequence_lines(f, L.stop_points(stops_(spark, sf)))


@query("SELECT version_id, route_item_id, trip_item_id, CAST(n AS INT) AS n, round(lon_sum, 6) AS lon_sum, first_lon FROM lines")
def sequence_lines(spark, sf):
    _, _, lines = _sequences(spark, sf)
    total = F.aggregate("line", F.lit(0.0), lambda a, p: a + p["lon"])
    return lines.select("version_id", "route_item_id", "trip_item_id", F.size("line").alias("n"), F.round(total, 6).alias("lon_sum"), F.col("line")[0]["lon"].alias("first_lon"))


@query("SELECT c.version_id, c.trip_item_id, f.trip_item_id AS line_trip_item_id FROM candidates c JOIN features f ON f.version_id = c.version_id AND f.route_item_id = c.route_item_id AND f.stop_item_ids = c.stop_item_ids SEMI JOIN lines l ON l.version_id = f.version_id AND l.route_item_id = f.route_item_id AND l.trip_item_id = f.trip_item_id")
def sequence_refs(spark, sf):
    return L.sequence_refs(*_sequences(spark, sf))


@query("""SELECT version_id, kind, k1, k2, row_number() OVER (PARTITION BY version_id ORDER BY kind, k1, k2) AS feature_id FROM (SELECT version_id, 0 AS kind, item_id AS k1, 0 AS k2 FROM points UNION ALL SELECT version_id, 1, route_item_id, shape_item_id FROM shaped UNION ALL SELECT version_id, 2, route_item_id, trip_item_id FROM lines)""")
def feature_numbers(spark, sf):
    _, _, lines = _sequences(spark, sf)
    return L.with_feature_ids(L.stop_points(stops_(spark, sf)), L.shape_lines(fx(spark, sf, "fx_trips"), shapes_(spark, sf)), lines)


@query("""SELECT least(greatest(min(stop_lon), -180e0), 180e0) AS west, least(greatest(min(stop_lat), -85.05112878e0), 85.05112878e0) AS south, least(greatest(max(stop_lon), -180e0), 180e0) AS east, least(greatest(max(stop_lat), -85.05112878e0), 85.05112878e0) AS north FROM points""")
def tiling_extent(spark, sf):
    return L.extent(L.stop_points(stops_(spark, sf)))


@query(f"""SELECT DISTINCT 7 AS parent_z, x AS parent_x, y AS parent_y, 9 AS z, CAST(x * 4 + a AS INT) AS x, CAST(y * 4 + b AS INT) AS y FROM (SELECT DISTINCT {X('stop_lon', 7)} AS x, {Y('stop_lat', 7)} AS y FROM points WHERE stop_lon <> 0), range(4) t(a), range(4) u(b)""")
def chunk_children(spark, sf):
    return L.child_tiles(L.own_tiles(L.stop_points(stops_(spark, sf)).filter("stop_lon <> 0"), 7), 9)


TILINGS = "SELECT source_id, id AS version_id, fetched_at AS generated_at FROM dx_versions WHERE id % 3 <> 1"


@query(f"""SELECT s.id AS source_id, a.id AS active_version_id, t.version_id AS tiled_version_id, CASE WHEN a.id IS NULL THEN 'no_active' WHEN a.id = t.version_id THEN 'already_current' ELSE 'synced' END AS outcome
FROM dx_sources s LEFT JOIN dx_versions a ON a.id = s.active_version_id AND a.source_id = s.id AND a.status = 'active' LEFT JOIN (SELECT source_id, arg_max(version_id, (generated_at, version_id)) AS version_id FROM ({TILINGS}) GROUP BY 1) t ON t.source_id = s.id""")
def tiling_staleness(spark, sf):
    v = fx(spark, sf, "dx_versions")
    tilings = v.filter("id % 3 <> 1").select("source_id", F.col("id").alias("version_id"), F.col("fetched_at").alias("generated_at"))
    return L.tiling_staleness(fx(spark, sf, "dx_sources"), v, tilings)


@query(f"SELECT source_id, version_id FROM ({TILINGS}) WHERE source_id <> 2 UNION ALL SELECT source_id, 1000 + id FROM dx_versions WHERE source_id = 2 AND status = 'active'")
def tiling_replaced(spark, sf):
    v = fx(spark, sf, "dx_versions")
    old = v.filter("id % 3 <> 1").select("source_id", F.col("id").alias("version_id"))
    return L.replace_tiling(old, v.filter("source_id = 2 and status = 'active'").select("source_id", (F.col("id") + 1000).alias("version_id")))


# Import: mentions and first-mention numbers.
MENTIONS = """SELECT 1 AS spec_ord, CAST(item_id AS BIGINT) AS row_ord, 0 AS ref_ord, 'stop' AS kind, item_gtfs_id AS gtfs_id FROM fx_stops WHERE version_id = 1
UNION ALL SELECT 1, item_id, 1, 'stop', 'S' || CAST(parent_station_item_id - 1 AS VARCHAR) FROM fx_stops WHERE version_id = 1 AND parent_station_item_id IS NOT NULL
UNION ALL SELECT 2, item_id, 0, 'route', item_gtfs_id FROM fx_routes WHERE version_id = 1
UNION ALL SELECT 3, item_id, 0, 'trip', item_gtfs_id FROM fx_trips WHERE version_id = 1
UNION ALL SELECT 3, item_id, 1, 'route', 'R' || CAST(route_item_id - 1 AS VARCHAR) FROM fx_trips WHERE version_id = 1 AND route_item_id IS NOT NULL
UNION ALL SELECT 3, item_id, 2, 'service', 'V' || CAST(service_item_id AS VARCHAR) FROM fx_trips WHERE version_id = 1
UNION ALL SELECT 3, item_id, 3, 'shape', 'H' || CAST(shape_item_id AS VARCHAR) FROM fx_trips WHERE version_id = 1 AND shape_item_id IS NOT NULL"""


@query(f"SELECT kind, gtfs_id, CAST(row_number() OVER (ORDER BY first_at) AS INT) AS item_id FROM (SELECT kind, gtfs_id, min((spec_ord, row_ord, ref_ord)) AS first_at FROM ({MENTIONS}) GROUP BY 1, 2)")
def id_translation(spark, sf):
    one = lambda v: fx(spark, sf, v).filter("version_id = 1")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    stops = one("fx_stops").select(F.col("item_id").alias("row_ord"), F.col("item_gtfs_id").alias("gtfs_id"), F.concat(F.lit("S"), (F.col("parent_station_item_id") - 1).cast("string")).alias("parent_gtfs_id"))
    routes = one("fx_routes").select(F.col("item_id").alias("row_ord"), F.col("item_gtfs_id").alias("gtfs_id"), F.lit("").alias("agency_gtfs_id"))
    trips = one("fx_trips").select(F.col("item_id").alias("row_ord"), F.col("item_gtfs_id").alias("gtfs_id"), F.concat(F.lit("R"), (F.col("route_item_id") - 1).cast("string")).alias("route_gtfs_id"), name("V", "service_item_id").alias("service_gtfs_id"), name("H", "shape_item_id").alias("shape_gtfs_id"))
    return G.id_map(G.mentions({"stops": stops, "routes": routes, "trips": trips})).select("kind", "gtfs_id", "item_id")


@query("""SELECT table_name, rule, n FROM (
SELECT 'trips' AS table_name, 'reference route_item_id' AS rule, count(*) AS n FROM fx_trips t ANTI JOIN fx_routes r ON r.version_id = t.version_id AND r.item_id = t.route_item_id WHERE t.route_item_id IS NOT NULL
UNION ALL SELECT 'trips', 'reference shape_item_id', count(*) FROM fx_trips t ANTI JOIN shapes s ON s.version_id = t.version_id AND s.shape_item_id = t.shape_item_id WHERE t.shape_item_id IS NOT NULL
UNION ALL SELECT 'trips', 'not null route_item_id', count(*) FROM fx_trips WHERE route_item_id IS NULL
UNION ALL SELECT 'stops', 'unique version_id,location_type', count(*) FROM (SELECT 1 FROM fx_stops GROUP BY version_id, location_type HAVING count(*) > 1)
UNION ALL SELECT 'versions', 'values status', count(*) FROM dx_versions WHERE status NOT IN ('active', 'imported', 'downloaded')) WHERE n > 0""")
def integrity_violations(spark, sf):
    tables = {"trips": fx(spark, sf, "fx_trips"), "stops": stops_(spark, sf), "routes": fx(spark, sf, "fx_routes"), "shapes": shapes_(spark, sf), "versions": fx(spark, sf, "dx_versions")}
    return G.violations(
        tables, {"stops": ["version_id", "location_type"], "trips": ["version_id", "item_id"]}, {"trips": ["route_item_id"]},
        [("trips", "route_item_id", "routes", "item_id"), ("trips", "shape_item_id", "shapes", "shape_item_id")], [("versions", "status", ("active", "imported", "downloaded"))],
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 9 AS INT) ELSE 0 END AS location_type, CASE WHEN p_partkey % 4 IN (0, 1) THEN CAST(p_partkey % 4 AS INT) ELSE 1 END AS timepoint,
upper(lpad(to_hex(p_partkey % 256), 2, '0') || lpad(to_hex(p_size), 2, '0') || '0A') AS color, strftime(DATE '2024-01-01' + CAST(p_partkey % 365 AS INT), '%Y%m%d') AS day, CAST(p_partkey % 30000 AS SMALLINT) AS seq FROM part""")
def code_cells(spark, sf):
    from .fixtures import table

    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", G.code(F.when(k % 3 == 0, (k % 9).cast("string")).otherwise(""), "location_type").alias("location_type"), G.code((k % 4).cast("string"), "timepoint").alias("timepoint"),
        G.hex_color(k % 256, F.col("p_size"), F.lit(10)).alias("color"), G.gtfs_date(F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int"))).alias("day"), G.checked_cast(k % 30000, "short").alias("seq"),
    )
