"""Queries of further scans, sinks and image operators."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from ..functions import spatial as S
from ..operators import fields as W
from ..operators import osm as O
from ..operators import raster as A
from ..operators import tiling as L
from ..operators import versions as V
from ..sources import readers as R
from ..sources import sinks as K
from .fixtures import fx, run, whole
from ..steps import root
from . import image_sql
from .q_map import AS_TILES, MANIFEST, _banded, _manifest, _tiles

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = whole(sql)
        return f

    return add


def _path(spark, name: str) -> str:
    return posixpath.join(root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@query("SELECT 'mdb-' || CAST(s_suppkey AS VARCHAR) AS slug, s_name AS provider, 'https://x.example/' || CAST(s_suppkey AS VARCHAR) AS url FROM supplier")
def catalogue_csv(spark, sf):
    """A catalogue with dotted headers, written as CSV and read back."""
    d = run(spark, sf, "SELECT 'mdb-' || CAST(s_suppkey AS VARCHAR(20)) AS slug, s_name, 'https://x.example/' || CAST(s_suppkey AS VARCHAR(20)) AS url FROM supplier")
    path = _path(spark, "catalogue")
    d.select(F.col("slug").alias("id"), F.lit("gtfs").alias("data_type"), F.col("s_name").alias("provider"), F.col("url").alias("urls.direct_download")).write.option("header", True).csv(path)
    return R.read_catalog_csv(spark, path).select(F.col("id").alias("slug"), "provider", F.col("`urls.direct_download`").alias("url"))


@query("SELECT slug, name, direct_download_url FROM dx_sources")
def seed_list(spark, sf):
    path = _path(spark, "seed")
    K_ = fx(spark, sf, "dx_sources").withColumns({c: F.lit(None).cast("string") for c in ("source_url", "license_url", "attribution")})
    R.write_seed(K_, path)
    return R.read_seed(spark, path).select("slug", "name", "direct_download_url")


@query("SELECT osm_type, osm_key, CAST(count(*) AS INT) AS n_tags, osm_key % 9 AS version FROM fx_osm_tags GROUP BY 1, 2")
def element_scan(spark, sf):
    t = fx(spark, sf, "fx_osm_tags").groupBy("osm_type", "osm_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("tags"))
    path = _path(spark, "elements")
    t.withColumn("attrs", F.struct((F.col("osm_key") % 9).cast("int").alias("version"), F.lit("2024-01-01").alias("timestamp"))).write.json(path)
    return R.read_osm(spark, path).select("osm_type", "osm_key", F.size("tags").alias("n_tags"), F.col("attrs.version").cast("long").alias("version"))


@query(f"SELECT tile_id, west, south, east, north FROM ({MANIFEST})")
def image_manifest(spark, sf):
    """Side-car files written one a folder, read as a manifest, and once more from its cache."""
    m = _manifest(spark, sf)
    path, cache = _path(spark, "images"), _path(spark, "manifest")
    m.select("tile_id", F.array("bounds.west", "bounds.south").alias("min"), F.array("bounds.east", "bounds.north").alias("max")).write.partitionBy("tile_id").json(path)
    raw = spark.read.schema("min array<double>, max array<double>, tile_id int").json(path)
    found = raw.select(F.col("tile_id").cast("string").alias("path"), F.struct(F.col("min")[0].alias("west"), F.col("min")[1].alias("south"), F.col("max")[0].alias("east"), F.col("max")[1].alias("north")).alias("bounds"))
    K.append_manifest(found, cache)
    return R.read_manifest(spark, path, cache).select(F.col("path").cast("int").alias("tile_id"), "bounds.*")


@query("SELECT tile_id, band, row_no, col_no, dn FROM dx_bands")
def band_scan(spark, sf):
    path = _path(spark, "bands")
    d = fx(spark, sf, "dx_bands")
    # Written as unsigned numbers, as some bands come.
    d.withColumn("dn", F.when(F.col("dn") < 0, F.col("dn") + 65536).otherwise(F.col("dn"))).write.parquet(path)
    return R.read_bands(spark, path)


@query("SELECT tile_id FROM (SELECT tile_id, band, max(row_no) AS h FROM dx_bands WHERE NOT (tile_id % 2 = 0 AND band = 1 AND row_no = 23) GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT h) > 1")
def band_sizes(spark, sf):
    d = fx(spark, sf, "dx_bands").filter("not (tile_id % 2 = 0 and band = 1 and row_no = 23)")
    return A.check_band_dims(d).select("tile_id")


UP = """SELECT CAST(z - 1 AS INT) AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((y % 2) * 12 + row_no // 2 AS INT) AS row_no, CAST((x % 2) * 12 + col_no // 2 AS INT) AS col_no, CAST(floor(avg(r) + 0.5) AS INT) AS r, CAST(floor(avg(g) + 0.5) AS INT) AS g, CAST(floor(avg(b) + 0.5) AS INT) AS b, CAST(floor(avg(a) + 0.5) AS INT) AS a FROM ({}) GROUP BY 1, 2, 3, 4, 5"""


@query(f"WITH four AS ({UP.format(AS_TILES)}) SELECT * FROM four UNION ALL {UP.format('SELECT * FROM four')}")
def image_pyramid(spark, sf):
    levels = A.xyz_pyramid(_tiles(spark, sf), 2)
    return levels[1].unionByName(levels[2])


@query(image_sql.QUADTREE)
def quad_pyramid(spark, sf):
    """The images between 0 and 80 degrees north as a quadtree of three levels, 16 pixels a side."""
    return A.quad_pyramid(fx(spark, sf, "dx_px"), _banded(_manifest(spark, sf)), 16, 2, _path(spark, "quadtree"))


@query(image_sql.RESAMPLED)
def tile_resample(spark, sf):
    """Windows about the lower right corner of every tile of the image whose tiles stand two abreast."""
    px = fx(spark, sf, "dx_px").withColumn("tx", (F.col("tile_id") % 2).cast("int")).withColumn("ty", F.floor(F.col("tile_id") / 2).cast("int"))
    tiles = px.select("tile_id", "tx", "ty").distinct()
    down = (tiles.agg(F.max("ty")).first()[0] or 0) + 1
    x, y = F.col("tx") * 24.0, F.col("ty") * -24.0
    windows = tiles.select(F.col("tile_id").alias("request"), S.box(x + 15.25, y - 29.5, x + 33.0, y - 11.75).alias("area"))
    return A.tile_resample(px, windows, (0.0, -24.0 * down, 48.0, 0.0), 24, 24, 2, down, 11, 9)


@query(image_sql.TILEJSON)
def tileset_json(spark, sf):
    return A.tilejson(_tiles(spark, sf).select("z", "x", "y").distinct(), "mosaic")


@query("SELECT version_id, shape_item_id, min(shape_pt_lon) AS west, min(shape_pt_lat) AS south, max(shape_pt_lon) AS east, max(shape_pt_lat) AS north FROM fx_shape_points WHERE shape_pt_lon IS NOT NULL AND shape_pt_lat IS NOT NULL GROUP BY 1, 2")
def footprints(spark, sf):
    p = fx(spark, sf, "fx_shape_points").groupBy("version_id", "shape_item_id").agg(F.collect_list(F.when(F.col("shape_pt_lon").isNotNull(), F.array("shape_pt_lon", "shape_pt_lat")).otherwise(F.array().cast("array<double>"))).alias("ring"))
    return p.select("version_id", "shape_item_id", A.footprint_bounds("ring").alias("b")).filter("b is not null").select("version_id", "shape_item_id", "b.*")


@query("SELECT osm_type, osm_key, CAST(sum(CASE WHEN k = 'amenity' THEN 0 ELSE 1 END) + 1 AS INT) AS n, coalesce(nullif(trim(max(CASE WHEN k = 'amenity' THEN v END)), ''), CASE WHEN max(CASE WHEN k = 'amenity' THEN 1 ELSE 0 END) = 0 THEN 'feature' END) AS amenity FROM fx_osm_tags GROUP BY 1, 2")
def merged_tags(spark, sf):
    t = fx(spark, sf, "fx_osm_tags").groupBy("osm_type", "osm_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("tags"))
    m = t.withColumn("all", O.merged("tags", F.create_map(F.lit("amenity"), F.lit("feature"))))
    return m.select("osm_type", "osm_key", F.size("all").alias("n"), O.first_tag("all", "amenity").alias("amenity"))


@query("""SELECT version_id, shape_item_id, CAST(CASE WHEN k <= 2 THEN 0 ELSE 1 END AS INT) AS part, string_agg(CAST(shape_pt_sequence AS VARCHAR), ',' ORDER BY k) AS points, round(sum(shape_pt_lon), 6) AS lons
FROM (SELECT *, row_number() OVER (PARTITION BY version_id, shape_item_id ORDER BY shape_pt_sequence) AS k, count(*) OVER (PARTITION BY version_id, shape_item_id) AS n FROM fx_shape_points WHERE shape_pt_lon IS NOT NULL) WHERE n > 2 GROUP BY 1, 2, 3""")
def exploded_parts(spark, sf):
    p = fx(spark, sf, "fx_shape_points").filter("shape_pt_lon is not null").groupBy("version_id", "shape_item_id").agg(F.array_sort(F.collect_list(F.struct("shape_pt_sequence", "shape_pt_lon"))).alias("l")).filter("size(l) > 2")
    parts = p.select("version_id", "shape_item_id", F.array(F.slice("l", 1, 2), F.slice("l", F.lit(3), F.size("l"))).alias("parts"))
    points = F.array_join(F.transform("line", lambda q: q["shape_pt_sequence"].cast("string")), ",")
    lons = F.aggregate("line", F.lit(0.0), lambda a, q: a + q["shape_pt_lon"])
    return W.explode_parts(parts, ["version_id", "shape_item_id"]).select("version_id", "shape_item_id", "part", points.alias("points"), F.round(lons, 6).alias("lons"))


@query("SELECT r.id, v.status, v.id IS NOT NULL AS known FROM (SELECT CAST(p_partkey * 9 AS INT) AS id FROM part) r LEFT JOIN dx_versions v ON v.id = r.id")
def version_requests(spark, sf):
    r = run(spark, sf, "SELECT CAST(p_partkey * 9 AS INT) AS id FROM part")
    return V.version_by_id(fx(spark, sf, "dx_versions"), r).select("id", "status", "known")


@query("SELECT v.source_id, v.id AS version_id FROM dx_versions v JOIN dx_sources s ON s.id = v.source_id WHERE s.slug = 'feed-7'")
def selected_tilings(spark, sf):
    t = fx(spark, sf, "dx_versions").select("source_id", F.col("id").alias("version_id"))
    return L.selected_tilings(t, fx(spark, sf, "dx_sources"), "feed-7").select("source_id", "version_id")


@query("SELECT feature_id, round(13e0 + (feature_id % 100) * 360e0 / 4096 / 8192 - 13e0, 9) AS d_lon, round(lat, 7) AS lat FROM (SELECT feature_id, degrees(atan(sinh(pi() * (1 - 2 * (2686 + (feature_id % 77) / 4096e0) / 8192)))) AS lat FROM fx_boxes)")
def tile_local_positions(spark, sf):
    k = F.col("feature_id")
    d = fx(spark, sf, "fx_boxes").select("feature_id", S.tile_to_lnglat(F.lit(13), F.lit(4400), F.lit(2686), k % 100, k % 77).alias("l"))
    return d.select("feature_id", F.round(F.col("l.lon") - (4400 / 8192 * 360 - 180), 9).alias("d_lon"), F.round("l.lat", 7).alias("lat"))


@query("SELECT feature_id, array_to_string([['BL', 'BR', 'TR', 'TL'][(n // CAST(pow(4, feature_id % 4 - k) AS BIGINT)) % 4 + 1] FOR k IN range(1, feature_id % 4 + 1)], '_') AS key FROM fx_boxes, LATERAL (SELECT unnest(range(CAST(pow(4, feature_id % 4) AS BIGINT))) AS n)")
def keys_of_depth(spark, sf):
    """All quadtree keys of a depth that each row asks for."""
    d = fx(spark, sf, "fx_boxes").select("feature_id", (F.col("feature_id") % 4).cast("int").alias("depth"))
    return S.quad_keys(d, "depth").select("feature_id", "key")


@query("SELECT count(*) FILTER (WHERE bad IS NOT NULL) AS tried, count(*) FILTER (WHERE NOT bad) AS succeeded, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE bad IS NULL) AS skipped FROM dx_sources s LEFT JOIN (SELECT source_id, bool_or(id % 13 = 0) AS bad FROM dx_versions WHERE status <> 'downloaded' GROUP BY 1) a ON a.source_id = s.id")
def tiling_summary(spark, sf):
    attempts = fx(spark, sf, "dx_versions").filter("status != 'downloaded'").select("source_id", F.when(F.col("id") % 13 == 0, "no stops").alias("error"))
    return L.tiling_summary(fx(spark, sf, "dx_sources"), attempts)


@query(f"SELECT tile_id, tile_id || '_' || i || '_' || j AS name, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(west + (east - west) * i / 3, 9) AS west, round(south + (north - south) * j / 3, 9) AS south, round(west + (east - west) * (i + 1) / 3, 9) AS east, round(south + (north - south) * (j + 1) / 3, 9) AS north FROM ({MANIFEST}), range(3) a(i), range(3) b(j)")
def split_image_bounds(spark, sf):
    d = A.split_bounds(_manifest(spark, sf), 10)
    return d.select("tile_id", "name", "i", "j", *[F.round(f"bounds.{c}", 9).alias(c) for c in ("west", "south", "east", "north")])


@query(f"""SELECT CAST(z - 1 AS INT) AS z, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST((y % 2) * 12 + kr AS INT) AS row_no, CAST((x % 2) * 12 + kc AS INT) AS col_no, CAST(floor(sum(r * wr * wc) / sum(wr * wc) + 0.5e0) AS INT) AS r, CAST(floor(sum(a * wr * wc) / sum(wr * wc) + 0.5e0) AS INT) AS a
FROM (SELECT t.*, kr, kc, CASE abs(2 * kr + 0.5e0 - row_no) WHEN 0.5e0 THEN 3e0 ELSE 1e0 END AS wr, CASE abs(2 * kc + 0.5e0 - col_no) WHEN 0.5e0 THEN 3e0 ELSE 1e0 END AS wc FROM ({AS_TILES}) t, range(12) i(kr), range(12) k(kc) WHERE abs(2 * kr + 0.5e0 - row_no) < 2 AND abs(2 * kc + 0.5e0 - col_no) < 2) GROUP BY 1, 2, 3, 4, 5""")
def parent_tiles_triangle(spark, sf):
    return A.parent_tiles(_tiles(spark, sf), "triangle").select("z", "x", "y", "row_no", "col_no", "r", "a")


@query("SELECT DISTINCT CAST(feature_id % 300 AS INT) AS tx, CAST(feature_id % 7 AS INT) AS ty FROM fx_boxes WHERE feature_id % 300 >= 200 OR feature_id % 7 = 6")
def tiles_without_chunk(spark, sf):
    from ..operators.roads import tiles_without_chunk as lost

    d = fx(spark, sf, "fx_boxes").select((F.col("feature_id") % 300).cast("int").alias("tx"), (F.col("feature_id") % 7).cast("int").alias("ty"))
    return lost(d, d.filter("tx < 200 and ty < 6")).select("tx", "ty")


@query("SELECT feature_id, CAST(CASE WHEN feature_id % 2 = 0 THEN 512 ELSE 4096 END AS INT) AS extent FROM fx_boxes WHERE layer = 'network'")
def selected_layer(spark, sf):
    k = F.col("feature_id")
    d = fx(spark, sf, "fx_boxes").withColumn("extent", F.when(k % 2 == 0, 512).when(k % 5 == 0, 0))
    return W.select_layer(d, "network").select("feature_id", "extent")


SQL["hilbert_order"] = whole(image_sql.HILBERT)
