"""Queries of road layers, map elements, rasters, tile measures, shapes and rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spatial as S
from ..operators import fields as W
from ..operators import osm as O
from ..operators import raster as A
from ..operators import roads as R
from ..operators import rolling as B
from ..operators import shapes as P
from ..steps import save
from .fixtures import fx, run, whole
from . import image_sql as I
from .q_spatial import LAT, X, Y

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = whole(sql)
        return f

    return add


# Roads.
TOUCH = "b.west <= t.east AND b.east >= t.west AND b.south <= t.north AND b.north >= t.south"
AREAS = "SELECT feature_id, west, south, east, north FROM fx_boxes"


def _areas(spark, sf):
    return run(spark, sf, AREAS)


GRID = f"""SELECT feature_id, x, y, round(tw, 9) AS west, round(tn, 9) AS north, round(greatest(tw - 100e0 / greatest(111320e0 * abs(cos(radians((ts + tn) * 0.5e0))), 1e0), -180e0), 9) AS x_west, round(tn + 100e0 / 111320e0, 9) AS x_north
FROM (SELECT feature_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, x / 8192e0 * 360e0 - 180e0 AS tw, {LAT('y', 13)} AS tn, {LAT('(y + 1)', 13)} AS ts FROM ({AREAS}), LATERAL (SELECT unnest(range({X('west', 13)}, {X('east', 13)} + 1)) AS x), LATERAL (SELECT unnest(range({Y('north', 13)}, {Y('south', 13)} + 1)) AS y))"""


@query(GRID)
def chunk_grid(spark, sf):
    return _grid(_areas(spark, sf))


# The same over every box, not over the requested areas alone.
@query(GRID.replace(f"({AREAS})", "fx_boxes"))
def chunk_grid_all(spark, sf):
    return _grid(fx(spark, sf, "fx_boxes"))


def _grid(areas):
    d = R.chunk_grid(areas.select("feature_id", "west", "south", "east", "north"), 13, 100.0)
    r = lambda c: F.round(c, 9)
    return d.select("feature_id", "x", "y", r("target.west").alias("west"), r("target.north").alias("north"), r("extraction.west").alias("x_west"), r("extraction.north").alias("x_north"))


@query(f"SELECT b.feature_id, t.feature_id AS box_id FROM fx_boxes b JOIN ({AREAS}) t ON {TOUCH}")
def features_in_boxes(spark, sf):
    boxes = _areas(spark, sf).select(F.col("feature_id").alias("box_id"), S.box("west", "south", "east", "north").alias("box"))
    return R.features_touching(fx(spark, sf, "fx_boxes"), boxes, ["box_id"]).select("feature_id", "box_id")


@query(f"SELECT t.feature_id AS box_id, count(*) AS n FROM fx_boxes b JOIN fx_boxes t ON {TOUCH} GROUP BY t.feature_id")
def features_in_all_boxes(spark, sf):
    boxes = fx(spark, sf, "fx_boxes").select(F.col("feature_id").alias("box_id"), S.box("west", "south", "east", "north").alias("box"))
    return R.count_touching(fx(spark, sf, "fx_boxes"), boxes, ["box_id"])


@query("""SELECT feature_id, CASE WHEN NOT (west < 13.5e0 AND east > 13.1e0 AND south < 52.5e0 AND north > 52.1e0) THEN 'area outside the source' WHEN feature_id % 9 = 0 THEN 'negative buffer' END AS error FROM fx_boxes""")
def area_checks(spark, sf):
    d = fx(spark, sf, "fx_boxes").select("feature_id", S.box("west", "south", "east", "north").alias("area"), S.box(*map(F.lit, (13.1, 52.1, 13.5, 52.5))).alias("source"), F.when(F.col("feature_id") % 9 == 0, -1.0).otherwise(5.0).alias("buffer_m"))
    return R.check_area(d).select("feature_id", "error")


CHUNKS = f"SELECT DISTINCT 13 AS z, {X('west', 13)} AS x, {Y('north', 13)} AS y FROM fx_boxes"


def _chunks(spark, sf):
    d = fx(spark, sf, "fx_boxes").select(F.lit(13).alias("z"), S.lon_to_tile_x("west", 13).alias("x"), S.lat_to_tile_y("north", 13).alias("y")).distinct()
    return d.withColumn("chunk", S.tile_id("z", "x", "y"))


@query(f"SELECT x, y, 12 AS zoom, x >> 1 AS tx, y >> 1 AS ty FROM ({CHUNKS}) UNION ALL SELECT x, y, 14, CAST(x * 2 + a AS INT), CAST(y * 2 + b AS INT) FROM ({CHUNKS}), range(2) t(a), range(2) u(b)")
def chunk_targets(spark, sf):
    c = _chunks(spark, sf)
    one = lambda z: R.target_tiles(c, z).select("x", "y", F.lit(z).alias("zoom"), "tx", "ty")
    return one(12).unionByName(one(14))


@query(f"""SELECT DISTINCT t.x >> 1 AS tx, t.y >> 1 AS ty, '13-' || c.x || '-' || c.y AS chunk FROM ({CHUNKS}) t JOIN ({CHUNKS}) c ON (t.x >> 1) BETWEEN greatest((c.x - 1), 0) // 2 AND (c.x + 1) // 2 AND (t.y >> 1) BETWEEN (c.y - 1) // 2 AND (c.y + 1) // 2""")
def tile_jobs(spark, sf):
    # The extraction bounds reach a quarter of a tile beyond the chunk's own.
    c = _chunks(spark, sf).withColumn("t", S.tile_bounds("z", "x", "y"))
    d = 360.0 / 8192 / 4
    c = c.withColumn("extraction", S.box(F.col("t.west") - d, F.col("t.south") - d / 2, F.col("t.east") + d, F.col("t.north") + d / 2))
    return R.tile_jobs(c, 12)


LAYERED = f"SELECT layer, class, feature_id % 3 AS v, CAST(x AS INT) AS tx, CAST(y AS INT) AS ty FROM fx_boxes, LATERAL (SELECT unnest(range({X('west', 12)}, {X('east', 12)} + 1)) AS x), LATERAL (SELECT unnest(range({Y('north', 12)}, {Y('south', 12)} + 1)) AS y)"


@query(f"SELECT DISTINCT tx, ty, layer, class, v FROM ({LAYERED}) SEMI JOIN (SELECT DISTINCT x >> 1 AS tx, y >> 1 AS ty FROM ({CHUNKS})) USING (tx, ty)")
def tile_layers(spark, sf):
    """What the features of each tile and layer hold: equal content once, whichever feature stands for it."""
    f = fx(spark, sf, "fx_boxes").withColumn("v", F.col("feature_id") % 3)
    rows = R.tile_layer_features(f, R.target_tiles(_chunks(spark, sf), 12), 12, ["class", "v"])
    held = R.tile_layers(rows).select("tx", "ty", "layer", F.explode("feature_ids").alias("feature_id"))
    return held.join(f.select("feature_id", "layer", "class", "v"), ["feature_id", "layer"]).select("tx", "ty", "layer", "class", "v")


@query(f"SELECT CAST(min(z) AS INT) AS min_zoom, CAST(max(z) AS INT) AS max_zoom, round(min(x) / 8192e0 * 360 - 180, 9) AS west, round({LAT('max(y) + 1', 13)}, 9) AS south, round((max(x) + 1) / 8192e0 * 360 - 180, 9) AS east, round({LAT('min(y)', 13)}, 9) AS north FROM ({CHUNKS})")
def tileset_stats(spark, sf):
    d = R.tileset_stats(_chunks(spark, sf))
    return d.select("min_zoom", "max_zoom", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


@query(f"SELECT 13 AS z, {X('west', 13)} AS x, {Y('north', 13)} AS y, count(*) AS n FROM fx_boxes GROUP BY 2, 3 HAVING count(*) > 1")
def duplicate_tiles(spark, sf):
    d = fx(spark, sf, "fx_boxes").select(F.lit(13).alias("z"), S.lon_to_tile_x("west", 13).alias("x"), S.lat_to_tile_y("north", 13).alias("y"))
    return R.duplicate_tiles(d)


@query("SELECT DISTINCT layer, k AS key, CASE k WHEN 'class' THEN 'String' WHEN 'one_way' THEN 'Boolean' WHEN 'width' THEN 'Number' ELSE 'String' END AS type FROM fx_boxes, (VALUES ('class'), ('one_way'), ('width'), ('mixed'), ('digits')) t(k)")
def inferred_fields(spark, sf):
    k = F.col("feature_id")
    mixed = F.when(k % 2 == 0, R.typed(F.lit(True), "flag")).otherwise(R.typed(F.lit(1.5), "number"))
    props = F.create_map(F.lit("class"), R.typed(F.col("class"), "text"), F.lit("one_way"), R.typed(k % 2 == 0, "flag"), F.lit("width"), R.typed(k % 7, "number"), F.lit("mixed"), mixed, F.lit("digits"), R.typed(k.cast("string"), "text"))
    return R.infer_fields(fx(spark, sf, "fx_boxes").select("layer", props.alias("properties")))


@query("SELECT feature_id, CASE feature_id % 5 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'parking' WHEN 3 THEN 'buffer' ELSE 'other' END AS lane FROM fx_boxes WHERE feature_id % 4 <> 1")
def lane_groups(spark, sf):
    k = F.col("feature_id")
    d = fx(spark, sf, "fx_boxes").withColumn("kind", F.element_at(F.array(*map(F.lit, ("Sidewalk", "Biking", "Parking(Parallel)", "Buffer(Verge)", "Driving"))), (k % 5 + 1).cast("int"))).withColumn("layer_no", F.when(k % 4 == 1, -1).when(k % 4 == 2, 1))
    good, _ = R.quarantine(R.surface_only(d), F.col("kind").isNull(), F.lit("no kind"))
    return good.select("feature_id", R.lane_group("kind").alias("lane"))


# Map elements.
def _elements(spark, sf):
    t = fx(spark, sf, "fx_osm_tags")
    return t.groupBy("osm_type", "osm_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("tags"))


@query("SELECT osm_type, osm_key, CAST(count(*) AS INT) AS n_tags, CASE osm_type WHEN 'N' THEN 'point' WHEN 'W' THEN 'line' ELSE 'collection' END AS kind FROM fx_osm_tags WHERE k <> 'source' GROUP BY 1, 2")
def cleaned_tags(spark, sf):
    return O.clean_tags(_elements(spark, sf)).select("osm_type", "osm_key", F.size("tags").alias("n_tags"), O.geom_kind("osm_type").alias("kind"))


@query("""SELECT osm_type, osm_key, nullif(trim(max(CASE WHEN k = 'amenity' THEN v END)), '') AS amenity,
nullif(concat_ws(' ', max(CASE WHEN k = 'addr:street' THEN v END), max(CASE WHEN k = 'addr:housenumber' THEN v END)), '') AS address, CASE nullif(trim(max(CASE WHEN k = 'amenity' THEN v END)), '') WHEN 'fast_food' THEN 'Fast Food' WHEN 'bank' THEN 'Bank' WHEN 'bench' THEN 'Bench' WHEN 'not_listed' THEN 'Not Listed' END AS label FROM fx_osm_tags GROUP BY 1, 2""")
def element_attributes(spark, sf):
    d = _elements(spark, sf)
    a = O.first_tag("tags", "amenity")
    return d.select("osm_type", "osm_key", a.alias("amenity"), O.address("tags").alias("address"), O.osm_label(a).alias("label"))


@query("""SELECT p_partkey, coalesce(a.badge, s.badge) AS badge, CASE WHEN p_partkey % 3 = 0 THEN 'icon-fast_food' WHEN p_partkey % 4 = 1 THEN 'icon-shop' ELSE 'default' END AS icon
FROM part LEFT JOIN (VALUES ('fast_food', 'food'), ('bank', 'money')) a(k, badge) ON a.k = CASE p_partkey % 5 WHEN 0 THEN 'fast_food' WHEN 1 THEN 'bank' ELSE 'bench' END LEFT JOIN (VALUES ('fast_food', 'food'), ('bank', 'money')) s(k, badge) ON s.k = CASE p_partkey % 3 WHEN 0 THEN 'fast_food' ELSE 'x' END""")
def poi_badges(spark, sf):
    d = run(spark, sf, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'fast_food' WHEN 1 THEN 'bank' ELSE 'bench' END AS amenity, CASE p_partkey % 3 WHEN 0 THEN 'fast_food' ELSE 'x' END AS subclass, CASE p_partkey % 4 WHEN 1 THEN 'shop' ELSE 'y' END AS class FROM part")
    amenities = spark.createDataFrame([("fast_food", "food"), ("bank", "money")], "key string, badge string")
    classes = spark.createDataFrame([("fast_food", "icon-fast_food"), ("shop", "icon-shop")], "key string, icon string")
    return O.poi_badge(d, amenities, classes).select("p_partkey", "badge", "icon")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://www.site' || c_custkey || '.example/a' ELSE 'http://site' || c_custkey || '.example' END AS url, 'site' || c_custkey || '.example' AS label, 'tel:' || replace(c_phone, ' ', '') AS phone FROM (SELECT *, '+49 30 ' || c_custkey AS c_phone FROM customer)")
def contact_links(spark, sf):
    c = run(spark, sf, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'www.site' || CAST(c_custkey AS VARCHAR(20)) || '.example/a' ELSE ' http://site' || CAST(c_custkey AS VARCHAR(20)) || '.example' END AS w, '+49 30 ' || CAST(c_custkey AS VARCHAR(20)) AS p FROM customer")
    return c.select("c_custkey", O.website("w").alias("url"), O.website_label("w").alias("label"), O.phone_link("p").alias("phone"))


@query("""SELECT user_id AS manifest_id, 'https://tiles.example' || arg_max(event_id, (ts, event_id)) || '/256' AS url FROM events GROUP BY 1""")
def latest_frames(spark, sf):
    e = run(spark, sf, "SELECT user_id, event_id, ts FROM events")
    m = e.groupBy(F.col("user_id").alias("manifest_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("f"))
    m = m.select("manifest_id", F.transform("f", lambda f: F.struct(f["event_id"].cast("string").alias("path"), f["ts"].alias("time"))).alias("frames"))
    return O.latest_frame(m, "https://tiles.example{}/256").select("manifest_id", "url")


@query("""SELECT r.osm_key, CASE r.osm_key % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'relation' ELSE 'node' END AS kind, e.osm_key IS NOT NULL AS found FROM (SELECT s_suppkey * 7 AS osm_key FROM supplier) r LEFT JOIN (SELECT DISTINCT osm_type, osm_key FROM fx_osm_tags) e ON e.osm_key = r.osm_key AND e.osm_type = CASE r.osm_key % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'W' WHEN 2 THEN 'R' ELSE 'N' END""")
def element_requests(spark, sf):
    from ..operators.transit import osm_lookup

    r = run(spark, sf, "SELECT s_suppkey * 7 AS osm_key FROM supplier").withColumn("kind", F.element_at(F.array(*map(F.lit, ("node", "way", "relation", "node"))), (F.col("osm_key") % 4 + 1).cast("int")))
    return osm_lookup(_elements(spark, sf), r).select("osm_key", "kind", "found")


@query("""SELECT layer, feature_id, place, class AS title FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY feature_id) AS place FROM fx_boxes) WHERE place <= 5""")
def inspected_features(spark, sf):
    d = fx(spark, sf, "fx_boxes").withColumn("properties", F.create_map(F.lit("name"), F.lit(" "), F.lit("class"), F.col("class")))
    return O.inspect_features(d, ["layer"], ["feature_id"], ("name", "class"), 5).select("layer", "feature_id", "place", "title")


# Rasters.
@query("""SELECT tile_id, row_no, col_no, CASE WHEN n THEN 0 ELSE r END AS r, CASE WHEN n THEN 0 ELSE g END AS g, CASE WHEN n THEN 0 ELSE b END AS b, CASE WHEN n THEN 0 ELSE 255 END AS a
FROM (SELECT tile_id, row_no, col_no, bool_or(dn = -32768) AS n, max(CASE WHEN band = 0 THEN t END) AS r, max(CASE WHEN band = 1 THEN t END) AS g, max(CASE WHEN band = 2 THEN t END) AS b
FROM (SELECT *, CAST(trunc(least(greatest(CAST(255 AS FLOAT) * CAST(2.5 AS FLOAT) * CAST(dn AS FLOAT) / CAST(10000 AS FLOAT), CAST(0 AS FLOAT)), CAST(255 AS FLOAT))) AS INT) AS t FROM dx_bands) GROUP BY 1, 2, 3)""")
def stacked_bands(spark, sf):
    return A.stack_bands(fx(spark, sf, "dx_bands"))


@query("SELECT p_partkey, CAST((SELECT min(d) FROM range(1, 60) t(d) WHERE n % d = 0 AND n / d <= 10) AS INT) AS divisor, CASE WHEN p_partkey % 3 = 0 THEN 'footprint' WHEN p_partkey % 3 = 1 THEN 'offset' ELSE 'error' END AS mode FROM (SELECT p_partkey, p_size + 1 AS n FROM part)")
def raster_divisors(spark, sf):
    d = run(spark, sf, "SELECT p_partkey, CAST(p_size + 1 AS INT) AS n, p_partkey % 3 = 0 AS s, CASE WHEN p_partkey % 3 = 1 THEN 'N18E000' ELSE 'x' END AS name FROM part")
    return d.select("p_partkey", A.smallest_divisor("n", 10).alias("divisor"), A.raster_mode("s", "name").alias("mode"))


@query("SELECT tile_id, CAST(col_no // 8 AS INT) AS i, CAST(2 - row_no // 8 AS INT) AS j, CAST(row_no % 8 AS INT) AS row_no, CAST(col_no % 8 AS INT) AS col_no, r FROM dx_px")
def split_images(spark, sf):
    px = fx(spark, sf, "dx_px")
    sizes = px.groupBy("tile_id").agg((F.max("col_no") + 1).alias("width"), (F.max("row_no") + 1).alias("height"))
    return A.split_tiles(px, sizes, 10).select("tile_id", "i", "j", "row_no", "col_no", "r")


AS_TILES = "SELECT 5 AS z, CAST(tile_id % 4 AS INT) AS x, CAST(tile_id // 4 AS INT) AS y, row_no, col_no, r, g, b, a FROM dx_px"


def _tiles(spark, sf):
    return fx(spark, sf, "dx_px").select(F.lit(5).alias("z"), (F.col("tile_id") % 4).alias("x"), F.floor(F.col("tile_id") / 4).cast("int").alias("y"), "row_no", "col_no", *"rgba")


@query(f"""SELECT CAST(z - 1 AS INT) AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((y % 2) * 12 + row_no // 2 AS INT) AS row_no, CAST((x % 2) * 12 + col_no // 2 AS INT) AS col_no, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(a) + 0.5) AS INT) AS a FROM ({AS_TILES}) GROUP BY 1, 2, 3, 4, 5""")
def parent_tiles(spark, sf):
    return A.parent_tiles(_tiles(spark, sf)).select("z", "x", "y", "row_no", "col_no", "r", "a")


@query(f"""SELECT CAST(z - 1 AS INT) AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((y % 2) * 12 + row_no // 2 AS INT) AS row_no, CAST((x % 2) * 12 + col_no // 2 AS INT) AS col_no, g FROM ({AS_TILES}) WHERE row_no % 2 = 0 AND col_no % 2 = 0""")
def parent_tiles_nearest(spark, sf):
    return A.parent_tiles(_tiles(spark, sf), "nearest").select("z", "x", "y", "row_no", "col_no", "g")


@query(f"SELECT z, x, y, count(*) AS n FROM ({AS_TILES}) WHERE x <> 1 GROUP BY 1, 2, 3")
def pending_tiles(spark, sf):
    t = _tiles(spark, sf).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return A.pending(t, t.filter("x = 1"), ["z", "x", "y"])


@query("SELECT CAST(tile_id % 4 * 24 + col_no - 14 AS INT) AS wx, CAST(tile_id // 4 * 24 + row_no - 5 AS INT) AS wy, r FROM dx_px WHERE tile_id % 4 * 24 + col_no >= 14 AND tile_id % 4 * 24 + col_no < 53 AND tile_id // 4 * 24 + row_no >= 5 AND tile_id // 4 * 24 + row_no < 16")
def image_window(spark, sf):
    px = _tiles(spark, sf).withColumnsRenamed({"x": "tx", "y": "ty"})
    return A.tile_window(px, 14, 5, 53, 16, 24, 24).select("wx", "wy", "r")


MANIFEST = I.MANIFEST


def _manifest(spark, sf):
    m = run(spark, sf, MANIFEST)
    return m.select("tile_id", "path", S.box("west", "south", "east", "north").alias("bounds"), F.lit(24).alias("width"), F.lit(24).alias("height"))


@query(f"SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM ({MANIFEST}) WHERE west <= 20 AND east >= 5 AND south <= 1000 AND north >= 2")
def mosaic_bounds(spark, sf):
    return A.mosaic_bounds(A.clip_interest(_manifest(spark, sf), 5.0, 2.0, 20.0, 1000.0))


@query(I.MOSAIC)
def mosaic_images(spark, sf):
    m = _manifest(spark, sf)
    requests = m.select(F.col("tile_id").alias("request"), S.box(F.col("bounds.west") + 4.0, F.col("bounds.south") + 1.0, F.col("bounds.west") + 14.0, F.col("bounds.south") + 9.0).alias("area"))
    return A.mosaic(fx(spark, sf, "dx_px"), m, requests, 12, 10)


def _banded(m):
    """The images between 0 and 80 degrees north: blocks of 36 stand side by side, and each 8 blocks a little further north than those before."""
    block = F.floor(F.col("tile_id") / 36)
    east, north = ((block + 4) % 8 - 4) * 37.0, -F.floor(F.col("tile_id") / 4) * 8.0 + F.floor(F.col("tile_id") % 36 / 4) * 8.0 + F.floor(block / 8) % 50 * 0.1
    return m.withColumn("bounds", S.box(F.col("bounds.west") + east, F.col("bounds.south") + north, F.col("bounds.east") + east, F.col("bounds.north") + north))


@query(I.MERCATOR)
def mercator_tiles(spark, sf):
    m = _banded(_manifest(spark, sf))
    return A.to_web_mercator(fx(spark, sf, "dx_px"), m, A.base_tiles(m, 5), 16)


@query(I.UTM)
def utm_images(spark, sf):
    m = _banded(_manifest(spark, sf))
    p = A.utm_forward(F.col("bounds.west"), F.col("bounds.north"), F.lit(3.0) + F.col("bounds.west"))
    images = m.withColumn("central_meridian", F.lit(3.0) + F.col("bounds.west")).withColumn("_p", p).withColumn("west_m", F.col("_p.easting")).withColumn("north_m", F.col("_p.northing")).withColumn("pixel_m", F.lit(50_000.0))
    return A.utm_to_lonlat(fx(spark, sf, "dx_px"), images)


DEM = "SELECT tile_id, row_no, col_no, (row_no * 100 + col_no * 10 + tile_id + 10000) * 10 AS packed FROM dx_px"


@query("""SELECT stop, tile_id, round(e * 1.5e0, 5) AS elevation FROM (SELECT stop, tile_id, (v * 23) * 100 + (u * 23) * 10 + tile_id AS e FROM (SELECT s.segment_id AS stop, t.tile_id, s.ax AS u, s.ay AS v FROM fx_segments s, (SELECT DISTINCT tile_id FROM dx_px) t))""")
def point_elevations(spark, sf):
    """Each stop's elevation on every tile."""
    tiles = fx(spark, sf, "dx_px").select("tile_id").distinct()
    pts = fx(spark, sf, "fx_segments").select(F.col("segment_id").alias("stop"), F.col("ax").alias("u"), F.col("ay").alias("v"))
    return A.elevation_at(pts.crossJoin(tiles), run(spark, sf, DEM), 1.5).select("stop", "tile_id", F.round("elevation", 5).alias("elevation"))


# Tile measures.
SEGS = "SELECT CAST(floor(segment_id / 25e0) AS INT) AS tile_id, segment_id, ax, ay, bx, by_ FROM fx_segments WHERE segment_id % 4 < 3 AND (ax <> bx OR ay <> by_)"


def dist(px, py):
    t = f"CASE WHEN (bx-ax)**2+(by_-ay)**2 > 0 THEN least(greatest((({px}-ax)*(bx-ax)+({py}-ay)*(by_-ay))/((bx-ax)**2+(by_-ay)**2),0e0),1e0) ELSE 0e0 END"
    return f"(({px}-(ax+(bx-ax)*({t})))**2 + ({py}-(ay+(by_-ay)*({t})))**2)"


@query(f"""SELECT tile_id, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, round(min(least(sqrt({dist('(c + 0.5e0) / 32', '(r + 0.5e0) / 24')}), 0.15e0) / 0.15e0), 6) AS value FROM ({SEGS}), range(24) a(r), range(32) b(c) GROUP BY 1, 2, 3""")
def edge_distances(spark, sf):
    e = run(spark, sf, SEGS).withColumnRenamed("by_", "by")
    return W.edge_distance(e, 32, 24, 0.15).withColumn("value", F.round("value", 6))


@query(f"""SELECT tile_id, point_id, round(sum(w * ux) / s, 6) AS dx, round(sum(w * uy) / s, 6) AS dy, round(sum(w), 6) AS weight FROM (SELECT *, sqrt(sum(w * ux) OVER p ** 2 + sum(w * uy) OVER p ** 2) AS s FROM (SELECT *, exp(-d / 0.0625e0) AS w, (bx - ax) / sqrt((bx-ax)**2+(by_-ay)**2) AS ux, (by_ - ay) / sqrt((bx-ax)**2+(by_-ay)**2) AS uy, row_number() OVER (PARTITION BY tile_id, point_id ORDER BY d, segment_id) AS n
FROM (SELECT s.*, q.point_id, {dist('q.x', 'q.y')} AS d FROM ({SEGS}) s JOIN (SELECT segment_id AS point_id, CAST(floor(segment_id / 25e0) AS INT) AS tile, 1 - ax AS x, ay AS y FROM fx_segments) q ON q.tile = s.tile_id)) WHERE n <= 4 WINDOW p AS (PARTITION BY tile_id, point_id)) GROUP BY tile_id, point_id, s HAVING s > 1e-9 AND sum(w) > 1e-9""")
def nearest_directions(spark, sf):
    pts = fx(spark, sf, "fx_segments").select(F.floor(F.col("segment_id") / 25).cast("int").alias("tile_id"), F.col("segment_id").alias("point_id"), (1 - F.col("ax")).alias("x"), F.col("ay").alias("y"))
    segs = run(spark, sf, SEGS).withColumnRenamed("by_", "by").withColumn("confidence", F.lit(1.0))
    d = W.knn_direction(pts, segs, ["tile_id"], 0.25, 4).filter("dx is not null")
    return d.select("tile_id", "point_id", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "weight")])


# A square with a square hole for each layer of boxes: points are the boxes' corners on the unit square.
RINGS = "SELECT t.tile_id AS polygon, e.ax + (t.tile_id % 20) * 0.01e0 AS ax, e.ay AS ay, e.bx + (t.tile_id % 20) * 0.01e0 AS bx, e.by_ AS by_ FROM (SELECT DISTINCT CAST(floor(segment_id / 25e0) AS INT) AS tile_id FROM fx_segments) t CROSS JOIN (SELECT 0.1e0 AS ax, 0.1e0 AS ay, 0.9e0 AS bx, 0.1e0 AS by_ UNION ALL SELECT 0.9e0, 0.1e0, 0.9e0, 0.9e0 UNION ALL SELECT 0.9e0, 0.9e0, 0.1e0, 0.9e0 UNION ALL SELECT 0.1e0, 0.9e0, 0.1e0, 0.1e0 UNION ALL SELECT 0.4e0, 0.4e0, 0.6e0, 0.4e0 UNION ALL SELECT 0.6e0, 0.4e0, 0.6e0, 0.6e0 UNION ALL SELECT 0.6e0, 0.6e0, 0.4e0, 0.6e0 UNION ALL SELECT 0.4e0, 0.6e0, 0.4e0, 0.4e0) e"
IN = "x >= {0}e0 + (p % 20) * 0.01e0 AND x < {1}e0 + (p % 20) * 0.01e0 AND y > {0}e0 AND y <= {1}e0"
INSIDE = f"({IN.format(0.1, 0.9)}) AND NOT ({IN.format(0.4, 0.6)})"
POLYGONS = "(SELECT DISTINCT CAST(floor(segment_id / 25e0) AS INT) AS p FROM fx_segments)"


def _rings(spark, sf):
    return run(spark, sf, RINGS).withColumnRenamed("by_", "by")


@query(f"SELECT feature_id, p AS polygon FROM (SELECT feature_id, (west - 13e0) / 0.7001e0 AS x, (south - 52e0) / 0.7003e0 AS y FROM fx_boxes), {POLYGONS} WHERE {INSIDE}")
def points_in_polygons(spark, sf):
    pts = fx(spark, sf, "fx_boxes").select("feature_id", ((F.col("west") - 13.0) / 0.7001).alias("x"), ((F.col("south") - 52.0) / 0.7003).alias("y"))
    return W.in_polygon(pts, _rings(spark, sf), ["feature_id"], "polygon", 0.05)


@query(f"SELECT segment_id, p AS polygon FROM fx_segments, {POLYGONS} WHERE ({INSIDE.replace('x ', 'ax ').replace('y ', 'ay ')}) AND ({INSIDE.replace('x ', 'bx ').replace('y ', 'by_ ')})")
def segments_in_polygons(spark, sf):
    s = fx(spark, sf, "fx_segments").withColumnRenamed("by_", "by")
    return W.segments_inside(s, _rings(spark, sf), "polygon", 0.05)


@query(f"SELECT DISTINCT segment_id, p AS polygon FROM (SELECT segment_id, ax AS x, ay AS y FROM fx_segments UNION ALL SELECT segment_id, bx, by_ FROM fx_segments UNION ALL SELECT segment_id, (ax + bx) / 2, (ay + by_) / 2 FROM fx_segments), {POLYGONS} WHERE {INSIDE}")
def segments_of_components(spark, sf):
    s = fx(spark, sf, "fx_segments").withColumnRenamed("by_", "by")
    return W.component_segments(s, _rings(spark, sf), "polygon", 0.05)


MASK = f"SELECT CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, p AS polygon FROM (SELECT r, c, (c + 0.5e0) / 40 AS x, (r + 0.5e0) / 40 AS y FROM range(40) a(r), range(40) b(c)), {POLYGONS} WHERE {INSIDE}"


@query(f"SELECT m.row_no, m.col_no, m.polygon, (SELECT count(*) FROM ({MASK}) n WHERE n.polygon = m.polygon AND abs(n.row_no - m.row_no) + abs(n.col_no - m.col_no) = 1) < 4 AS boundary FROM ({MASK}) m")
def raster_masks(spark, sf):
    return W.raster_mask(_rings(spark, sf), "polygon", 40)


@query(f"SELECT row_no, col_no, polygon, round(col_no - avg(col_no) OVER (PARTITION BY polygon), 6) AS centered FROM ({MASK})")
def component_means(spark, sf):
    d = W.center_by_component(W.raster_mask(_rings(spark, sf), "polygon", 40), ["polygon"], "col_no")
    return d.select("row_no", "col_no", "polygon", F.round("centered", 6).alias("centered"))


@query(I.COMPONENTS)
def grid_components(spark, sf):
    cells = run(spark, sf, "SELECT tile_id, row_no, col_no FROM dx_bands WHERE band = 0 AND (row_no * 7 + col_no * 5 + tile_id) % 3 <> 0")
    return W.grid_components(cells, ["tile_id"], save)


@query("SELECT layer, 4096 AS extent, count(*) AS n_features FROM fx_boxes GROUP BY 1")
def layer_summaries(spark, sf):
    return W.layer_summary(fx(spark, sf, "fx_boxes").withColumn("extent", F.lit(4096)))


@query("SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 2e0 ELSE 0e0 END AS base, greatest(feature_id % 30 + 0e0, CASE WHEN feature_id % 3 = 0 THEN 2e0 ELSE 0e0 END + 0.1e0) AS top FROM fx_boxes WHERE class IN ('BUILDING', 'MACHINERY') AND feature_id % 4 <> 0")
def building_heights(spark, sf):
    k = F.col("feature_id")
    props = F.create_map(F.lit("class"), F.col("class"), F.lit("height"), F.when(k % 4 == 0, "tall").otherwise("x"), F.lit("render_height"), F.when(k % 4 != 0, (k % 30).cast("string")), F.lit("min_height"), F.when(k % 3 == 0, "2"))
    d = W.class_filter(fx(spark, sf, "fx_boxes").withColumn("properties", props), "class", ("BUILDING", "MACHINERY"))
    return W.building_heights(d, ("height", "render_height"), ("min_height",)).select("feature_id", "base", "top")


@query("SELECT layer, feature_id AS place, CASE WHEN row_number() OVER (PARTITION BY layer, feature_id % 100 ORDER BY feature_id) = 1 THEN CAST(feature_id % 100 AS VARCHAR) ELSE CAST(CAST(9223372036854775808 AS HUGEINT) + feature_id AS VARCHAR) END AS new_id FROM fx_boxes")
def repaired_ids(spark, sf):
    d = fx(spark, sf, "fx_boxes").select("layer", F.col("feature_id").alias("place"), (F.col("feature_id") % 100).alias("id"))
    return W.repair_feature_ids(d, ["layer"]).select("layer", "place", F.col("new_id").cast("string").alias("new_id"))


@query("SELECT round(avg(abs(ax - 0.5e0)), 9) AS mean FROM fx_segments WHERE segment_id % 5 <> 0")
def finite_mean(spark, sf):
    d = fx(spark, sf, "fx_segments").withColumn("v", F.when(F.col("segment_id") % 5 == 0, float("nan")).otherwise(F.col("ax") - 0.5))
    return W.finite_abs_mean(d, "v").select(F.round("mean", 9).alias("mean"))


@query("""SELECT tile_id, point_id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(ax - (ax * nx + ay * ny) * nx, 6) AS tx FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, point_id ORDER BY d, segment_id) AS n FROM (SELECT s.tile_id, s.segment_id, q.point_id, q.x AS ax, q.y AS ay, -(by_ - s.ay) / sqrt((bx-s.ax)**2+(by_-s.ay)**2) AS nx, (bx - s.ax) / sqrt((bx-s.ax)**2+(by_-s.ay)**2) AS ny, """ + dist("q.x", "q.y").replace("ax", "s.ax").replace("(ay", "(s.ay").replace("-ay", "-s.ay") + f""" AS d FROM ({SEGS}) s JOIN (SELECT segment_id AS point_id, CAST(floor(segment_id / 25e0) AS INT) AS tile, 1 - ax AS x, ay AS y FROM fx_segments) q ON q.tile = s.tile_id)) WHERE n = 1""")
def nearest_normals(spark, sf):
    pts = fx(spark, sf, "fx_segments").select(F.floor(F.col("segment_id") / 25).cast("int").alias("tile_id"), F.col("segment_id").alias("point_id"), (1 - F.col("ax")).alias("x"), F.col("ay").alias("y"))
    n = W.nearest_normal(pts, run(spark, sf, SEGS).withColumnRenamed("by_", "by"), ["tile_id"]).join(pts, ["tile_id", "point_id"])
    return n.select("tile_id", "point_id", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"), F.round(W.project_tangent("x", "y", "nx", "ny")["x"], 6).alias("tx"))


_LINES = "SELECT version_id, shape_item_id, shape_pt_lon AS ax, shape_pt_lat AS ay, CAST(row_number() OVER w - 1 AS INT) AS seg, {} AS bx, {} AS by_ FROM fx_shape_points WHERE shape_pt_lon IS NOT NULL AND shape_pt_lat IS NOT NULL WINDOW w AS (PARTITION BY version_id, shape_item_id ORDER BY shape_pt_sequence), v AS (PARTITION BY version_id, shape_item_id ORDER BY shape_pt_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_LEAD = [f"lead({c}) OVER w" for c in ("shape_pt_lon", "shape_pt_lat")]
_RING = [f"coalesce({x}, first_value({c}) OVER v)" for x, c in zip(_LEAD, ("shape_pt_lon", "shape_pt_lat"))]
_DIRECTED = "SELECT version_id, shape_item_id, seg, ax, ay, bx, by_ AS \"by\", round((bx - ax) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), 6) AS dx, round((by_ - ay) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), 6) AS dy FROM ({}) WHERE (bx <> ax OR by_ <> ay)"


def _lines(spark, sf):
    from ..operators.gtfs_import import shapes_seq

    return shapes_seq(fx(spark, sf, "fx_shape_points")).filter("line is not null").withColumn("line", F.transform("line", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))


def _directed(segs):
    return segs.select("version_id", "shape_item_id", "seg", "ax", "ay", "bx", "by", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query(_DIRECTED.format(_LINES.format(*_LEAD)))
def line_segments(spark, sf):
    return _directed(W.segments(_lines(spark, sf), ["version_id", "shape_item_id"]))


@query(_DIRECTED.format(_LINES.format(*_RING)))
def ring_segments(spark, sf):
    return _directed(W.segments(_lines(spark, sf), ["version_id", "shape_item_id"], closed=True))


# Shapes.
def encoded(spark, sf):
    """Legs of three points whose deltas are encoded with precision 0, from the tables: a value v is the character of 63 + 2 v (v below 16)."""
    d = run(spark, sf, "SELECT o_custkey AS trip, o_orderkey AS leg, CAST(o_orderkey % 15 AS INT) AS a, CAST(o_custkey % 15 AS INT) AS b FROM orders")
    ch = lambda v: F.char(63 + 2 * F.col(v))
    return d.select("trip", "leg", F.concat(ch("a"), ch("b"), ch("b"), ch("a"), ch("a"), ch("a")).alias("shape"))


POINTS = "SELECT trip, leg, CAST(p AS INT) AS point, CASE p WHEN 0 THEN a WHEN 1 THEN a + b ELSE a + b + a END + 0e0 AS lat, CASE p WHEN 0 THEN b WHEN 1 THEN a + b ELSE a + b + a END + 0e0 AS lon FROM (SELECT o_custkey AS trip, o_orderkey AS leg, o_orderkey % 15 AS a, o_custkey % 15 AS b FROM orders), range(3) r(p)"


@query(POINTS)
def polyline_points(spark, sf):
    return P.polyline_points(encoded(spark, sf), ["trip", "leg"], 0)


@query(f"SELECT trip, CAST(count(*) AS INT) AS n, sum(lon) AS lon_sum, arg_min(lat, (leg, point)) AS first_lat FROM ({POINTS}) GROUP BY 1")
def trip_lines(spark, sf):
    d = P.trip_lines_from_legs(P.polyline_points(encoded(spark, sf), ["trip", "leg"], 0), "trip", "leg")
    return d.select("trip", F.size("line").alias("n"), F.aggregate("line", F.lit(0.0), lambda a, p: a + p["lon"]).alias("lon_sum"), F.col("line")[0]["lat"].alias("first_lat"))


@query(f"SELECT trip, CASE WHEN trip % 3 = 0 THEN 1e0 ELSE west END AS west, CASE WHEN trip % 3 = 0 THEN 2e0 ELSE south END AS south, CASE WHEN trip % 3 = 0 THEN 3e0 ELSE east END AS east, CASE WHEN trip % 3 = 0 THEN 4e0 ELSE north END AS north FROM (SELECT trip, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM ({POINTS}) GROUP BY 1)")
def trip_bounds(spark, sf):
    pts = P.polyline_points(encoded(spark, sf), ["trip", "leg"], 0)
    trips = run(spark, sf, "SELECT DISTINCT o_custkey AS trip FROM orders").select("trip", *[F.when(F.col("trip") % 3 == 0, float(k)).when(F.col("trip") % 3 == 1, float("nan")).alias(c) for k, c in enumerate(("west", "south", "east", "north"), 1)])
    return P.trip_bounds(trips, pts, "trip")


@query(f"SELECT trip, 'start' AS \"end\", round(2 * {S.EARTH_RADIUS} * asin(sqrt(sin(radians(0.001e0) / 2) ** 2)), 4) AS meters FROM ({POINTS}) GROUP BY trip HAVING trip % 2 = 0")
def trip_connectors(spark, sf):
    lines = P.trip_lines_from_legs(P.polyline_points(encoded(spark, sf), ["trip", "leg"], 0), "trip", "leg")
    gap = F.when(F.col("trip") % 2 == 0, 0.001).otherwise(0.0001)
    p = lambda q, d: F.struct(q["lon"].alias("lon"), (q["lat"] + d).alias("lat"))
    places = lines.select("trip", F.array(p(F.col("line")[0], gap), p(F.element_at("line", -1), F.lit(0.0))).alias("locations"))
    return P.connectors(lines, places, "trip").select("trip", "end", F.round("meters", 4).alias("meters"))


# Rolling windows.
def _samples(spark, sf):
    e = fx(spark, sf, "fx_frames")
    return e.select("user_id", "event_id", F.unix_millis(F.col("ended_at").cast("timestamp")).alias("ms"), "duration_ms")


W10, W60 = 36_000_000, 216_000_000
EVENTS = "SELECT user_id, event_id, epoch_us(ended_at) // 1000 AS ms, duration_ms FROM fx_frames"


@query(f"SELECT event_id, round(n / (least({W10}, greatest(ms - lo, 1000)) / 1000e0), 9) AS rate FROM (SELECT *, count(*) OVER w AS n, min(ms) OVER w AS lo FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W10} PRECEDING AND CURRENT ROW))")
def rolling_rate(spark, sf):
    return B.rolling_rate(_samples(spark, sf), "user_id", "ms", W10).select("event_id", F.round("rate", 9).alias("rate"))


@query(f"SELECT event_id, count(*) OVER w AS n_a, round(avg(duration_ms) OVER w, 6) AS avg_a, max(duration_ms) OVER w AS max_a, count(*) OVER v AS n_b, min(duration_ms) OVER v AS min_b FROM ({EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W10} PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W60} PRECEDING AND CURRENT ROW)")
def rolling_stats(spark, sf):
    d = B.rolling_stats(_samples(spark, sf), "user_id", "ms", "duration_ms", {"a": W10, "b": W60})
    return d.select("event_id", "n_a", F.round("avg_a", 6).alias("avg_a"), "max_a", "n_b", "min_b")


@query(f"SELECT event_id, round(list_sort(l)[CAST(greatest(ceil(len(l) * 0.9e0), 1) AS INT)] * 0.1e0, 6) AS p90 FROM (SELECT event_id, list(CAST(least(greatest(floor(duration_ms / 0.1e0 + 0.5e0), 0), 10000) AS INT)) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W60} PRECEDING AND CURRENT ROW) AS l FROM ({EVENTS}))")
def rolling_p90(spark, sf):
    return B.rolling_p90(_samples(spark, sf), "user_id", "ms", "duration_ms", W60).select("event_id", F.round("p90", 6).alias("p90"))


@query(f"SELECT user_id, count(*) AS n, sum(event_id) AS ids FROM (SELECT *, max(ms) OVER (PARTITION BY user_id) AS newest FROM ({EVENTS})) WHERE ms >= newest - {W60} GROUP BY 1")
def recent_samples(spark, sf):
    return B.recent(_samples(spark, sf), "user_id", "ms", W60).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


RESULTS = "SELECT user_id AS tile, event_id AS seq, event_id % 5 AS revision, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'p' || CAST(event_id AS VARCHAR(20)) END AS payload FROM events"


LATEST = f"""WITH r AS ({RESULTS}), q AS (SELECT tile, max(revision) AS last FROM (SELECT user_id AS tile, event_id % 4 AS revision FROM events) GROUP BY 1), n AS (SELECT r.tile, arg_max((ok, payload), seq) AS now FROM r JOIN q ON q.tile = r.tile AND q.last = r.revision GROUP BY 1), b AS (SELECT r.tile, arg_max(payload, (revision, seq)) AS before FROM r JOIN q ON q.tile = r.tile WHERE ok AND payload <> '' AND revision < last GROUP BY 1)
SELECT q.tile, CASE WHEN n.tile IS NULL OR (now[1] AND now[2] = '') THEN before WHEN now[1] THEN now[2] END AS payload FROM q LEFT JOIN n ON n.tile = q.tile LEFT JOIN b ON b.tile = q.tile"""


@query(LATEST)
def latest_revisions(spark, sf):
    asked = run(spark, sf, "SELECT user_id AS tile, event_id % 4 AS revision FROM events")
    return B.latest_revision(run(spark, sf, RESULTS), asked, "tile")
