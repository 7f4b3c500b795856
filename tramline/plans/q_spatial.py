"""Queries over the spatial expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import spatial as S
from .fixtures import fx, whole

R9 = lambda c, name: F.round(c, 9).alias(name)
MAXLAT = S.MAX_LAT


def tile_addresses(spark, sf):
    d = fx(spark, sf, "fx_stops").filter("stop_lon is not null")
    b = d.select("version_id", "item_id", "stop_lon", "stop_lat", S.lon_to_tile_x("stop_lon", 13).alias("x"), S.lat_to_tile_y("stop_lat", 13).alias("y"))
    b = b.withColumn("b", S.tile_bounds(F.lit(13), "x", "y"))
    return b.select("version_id", "item_id", S.tile_id(F.lit(13), "x", "y").alias("tile"), *[R9(F.col(f"b.{k}"), k) for k in ("west", "south", "east", "north")], S.contains_lon_lat("b", "stop_lon", S.clamp("stop_lat", F.lit(-MAXLAT), F.lit(MAXLAT))).alias("inside"))


def X(lon, z):
    return f"CAST(least(greatest(floor((least(greatest({lon}, -180e0), 180e0) + 180e0) / 360e0 * {2**z}), 0), {2**z - 1}) AS INT)"


def Y(lat, z):
    r = f"radians(least(greatest({lat}, -{MAXLAT}e0), {MAXLAT}e0))"
    return f"CAST(least(greatest(floor((1e0 - ln(tan({r}) + 1e0 / cos({r})) / pi()) / 2e0 * {2**z}), 0), {2**z - 1}) AS INT)"


def LAT(y, z):
    return f"degrees(atan(sinh(pi() * (1e0 - 2e0 * ({y}) / {2**z}))))"


TILE_ADDRESSES = whole(f"""
SELECT version_id, item_id, '13-' || x || '-' || y AS tile, round(west, 9) AS west, round(south, 9) AS south, round(east, 9) AS east, round(north, 9) AS north,
       stop_lon >= west AND stop_lon <= east AND lat >= south AND lat <= north AS inside
FROM (SELECT *, x / 8192e0 * 360e0 - 180e0 AS west, (x + 1) / 8192e0 * 360e0 - 180e0 AS east, {LAT('y + 1', 13)} AS south, {LAT('y', 13)} AS north, least(greatest(stop_lat, -{MAXLAT}e0), {MAXLAT}e0) AS lat
      FROM (SELECT *, {X('stop_lon', 13)} AS x, {Y('stop_lat', 13)} AS y FROM fx_stops WHERE stop_lon IS NOT NULL))
""")


def tiles_of_boxes(spark, sf):
    d = fx(spark, sf, "fx_boxes")
    return S.tiles_for_bounds(d, "west", "south", "east", "north", 13).select("feature_id", "x", "y", S.count_tiles("west", "south", "east", "north", 10, 14).alias("n_tiles"))


TILES_OF_BOXES = whole(f"""
SELECT feature_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
       CAST({' + '.join(f"(({X('east', z)} - {X('west', z)} + 1) * ({Y('south', z)} - {Y('north', z)} + 1))" for z in range(10, 15))} AS BIGINT) AS n_tiles
FROM fx_boxes, LATERAL (SELECT unnest(range({X('west', 13)}, {X('east', 13)} + 1)) AS x), LATERAL (SELECT unnest(range({Y('north', 13)}, {Y('south', 13)} + 1)) AS y)
""")


def parsed_bounds(spark, sf):
    d = fx(spark, sf, "fx_boxes")
    text = F.concat_ws(",", F.when(F.col("feature_id") % 7 == 0, "x").otherwise(F.col("west").cast("decimal(18,6)").cast("string")), *[F.col(c).cast("decimal(18,6)").cast("string") for c in ("south", "east", "north")])
    d = d.withColumn("p", S.parse_bounds(text))
    g = d.withColumn("g", S.expand_meters("p.west", "p.south", "p.east", "p.north", F.lit(250.0)))
    return g.select("feature_id", F.col("p.valid").alias("valid"), *[R9(F.col(f"g.{k}"), k) for k in ("west", "south", "east", "north")])


PARSED_BOUNDS = whole(f"""
SELECT feature_id, coalesce(w >= -180 AND e <= 180 AND s >= -{MAXLAT} AND n <= {MAXLAT} AND w < e AND s < n, false) AS valid,
       CASE WHEN w IS NOT NULL THEN round(greatest(w - dlon, -180e0), 9) ELSE -180e0 END AS west, round(greatest(s - 250e0 / 111320e0, -{MAXLAT}e0), 9) AS south,
       round(least(e + dlon, 180e0), 9) AS east, round(least(n + 250e0 / 111320e0, {MAXLAT}e0), 9) AS north
FROM (SELECT *, 250e0 / greatest(111320e0 * abs(cos(radians((s + n) * 0.5e0))), 1e0) AS dlon
      FROM (SELECT feature_id, CASE WHEN feature_id % 7 <> 0 THEN CAST(CAST(west AS DECIMAL(18,6)) AS DOUBLE) END AS w, CAST(CAST(south AS DECIMAL(18,6)) AS DOUBLE) AS s,
                   CAST(CAST(east AS DECIMAL(18,6)) AS DOUBLE) AS e, CAST(CAST(north AS DECIMAL(18,6)) AS DOUBLE) AS n FROM fx_boxes))
""")


def box_algebra(spark, sf):
    a = fx(spark, sf, "fx_boxes").select("feature_id", S.box("west", "south", "east", "north").alias("a"))
    # Each box beside the next one by id.
    b = a.select((F.col("feature_id") - 1).alias("feature_id"), F.col("a").alias("b"))
    d = a.join(b, "feature_id").select("*", S.box_union("a", "b").alias("u"), S.box_intersection("a", S.box_expand("b", F.lit(0.2))).alias("i"), S.box_center("a").alias("c"), S.box_size("b").alias("s"))
    d = d.withColumn("p", S.closest_point("a", "b.west", "b.south"))
    return d.select(
        "feature_id", S.intersects("a", "b").alias("strict"), S.intersects("a", "b", True).alias("touching"),
        *[R9(F.col(f"{k}.{e}"), f"{k}_{e}") for k in ("u", "i") for e in ("west", "south", "east", "north")],
        R9(F.col("c.lon"), "c_lon"), R9(F.col("c.lat"), "c_lat"), R9(F.col("s.width"), "width"), R9(F.col("s.height"), "height"), R9(F.col("p.lon"), "p_lon"), R9(F.col("p.lat"), "p_lat"),
    )


BOX_ALGEBRA = whole("""
SELECT a.feature_id, a.west < b.east AND a.east > b.west AND a.south < b.north AND a.north > b.south AS strict,
       a.west <= b.east AND a.east >= b.west AND a.south <= b.north AND a.north >= b.south AS touching,
       round(least(a.west, b.west), 9) AS u_west, round(least(a.south, b.south), 9) AS u_south, round(greatest(a.east, b.east), 9) AS u_east, round(greatest(a.north, b.north), 9) AS u_north,
       CASE WHEN i THEN round(greatest(a.west, b.west - 0.2e0), 9) END AS i_west, CASE WHEN i THEN round(greatest(a.south, b.south - 0.2e0), 9) END AS i_south,
       CASE WHEN i THEN round(least(a.east, b.east + 0.2e0), 9) END AS i_east, CASE WHEN i THEN round(least(a.north, b.north + 0.2e0), 9) END AS i_north,
       round((a.west + a.east) / 2e0, 9) AS c_lon, round((a.south + a.north) / 2e0, 9) AS c_lat, round(b.east - b.west, 9) AS width, round(b.north - b.south, 9) AS height,
       round(least(greatest(b.west, a.west), a.east), 9) AS p_lon, round(least(greatest(b.south, a.south), a.north), 9) AS p_lat
FROM fx_boxes a JOIN fx_boxes b ON b.feature_id = a.feature_id + 1,
     LATERAL (SELECT a.west <= b.east + 0.2e0 AND a.east >= b.west - 0.2e0 AND a.south <= b.north + 0.2e0 AND a.north >= b.south - 0.2e0 AS i)
""")


def xyz_ranges(spark, sf):
    d = fx(spark, sf, "fx_boxes")
    r = d.select("feature_id", S.xyz_tile_range("west", "south", "east", "north", 14).alias("r"))
    r = r.withColumn("m", S.tile_bounds_radians(F.lit(14), "r.x_min", "r.y_min"))
    return r.select("feature_id", "r.*", *[R9(F.col(f"m.{k}"), k) for k in ("min_x", "min_y", "max_x", "max_y")])


XYZ_RANGES = whole("""
SELECT feature_id, x_min, x_max, y_min, y_max, round(x_min * s - pi(), 9) AS min_x, round(pi() - (y_min + 1) * s, 9) AS min_y, round((x_min + 1) * s - pi(), 9) AS max_x, round(pi() - y_min * s, 9) AS max_y
FROM (SELECT feature_id, s, CAST(floor((radians(west) + pi()) / s) AS INT) AS x_min, CAST(ceil((radians(east) + pi()) / s) - 1 AS INT) AS x_max,
             CAST(floor((pi() - ln(tan(pi() / 4 + radians(north) / 2e0))) / s) AS INT) AS y_min, CAST(ceil((pi() - ln(tan(pi() / 4 + radians(south) / 2e0))) / s) - 1 AS INT) AS y_max
      FROM fx_boxes, (SELECT 2e0 * pi() / 16384e0 AS s))
""")


def mercator_coordinates(spark, sf):
    d = fx(spark, sf, "fx_stops").filter("stop_lat is not null").select("version_id", "item_id", "stop_lat", S.mercator("stop_lon", "stop_lat", F.lit(123.0)).alias("m"))
    d = d.withColumn("l", S.mercator_to_lnglat("m.x", "m.y", "m.z")).withColumn("a", S.approx_size(F.lit(0.1), F.radians("stop_lat"), F.lit(0.2), F.radians("stop_lat") + 0.01))
    d = d.withColumn("p", S.bounded_mercator(F.lit(4.0), F.radians("stop_lat"), -1.4, 1.4))
    return d.select(
        "version_id", "item_id", R9(F.col("m.x"), "x"), R9(F.col("m.y"), "y"), F.round(F.col("m.z") * 1e6, 6).alias("z6"), F.round("l.lon", 6).alias("lon"), F.round("l.lat", 6).alias("lat"), F.round("l.altitude", 6).alias("altitude"),
        F.round(S.mercator_scale("stop_lat"), 6).alias("scale"), F.round(S.meters_unit("m.y") * 1e9, 6).alias("unit9"), F.round("a.width", 5).alias("width"), F.round("a.height", 5).alias("height"), R9(F.col("p.x"), "px"), R9(F.col("p.y"), "py"),
        S.utc_offset_minutes(F.col("stop_lat") * 7).alias("utc_minutes"),
    )


C = S.EARTH_CIRCUMFERENCE
MERCATOR_COORDINATES = whole(f"""
SELECT version_id, item_id, round(x, 9) AS x, round(y, 9) AS y, round(123e0 / ({C!r} * cos(radians(stop_lat))) * 1e6, 6) AS z6,
       round(stop_lon, 6) AS lon, round(stop_lat, 6) AS lat, 123e0 AS altitude, round(1e0 / cos(radians(stop_lat)), 6) AS scale, round(1e9 / cos(radians(stop_lat)) / {C!r}, 6) AS unit9,
       round(degrees(0.1e0) * 111320e0 * greatest(cos(radians(stop_lat)), cos(radians(stop_lat) + 0.01e0)), 5) AS width, round(degrees(0.01e0) * 111320e0, 5) AS height,
       round(pi(), 9) AS px, round(ln(tan(pi() / 4 + least(radians(stop_lat), 1.4e0) / 2e0)), 9) AS py,
       CAST(least(greatest(floor((((stop_lat * 7 + 180) % 360 + 360) % 360 - 180) / 15e0 + 0.5e0) * 60, -720), 840) AS INT) AS utc_minutes
FROM (SELECT *, (180e0 + stop_lon) / 360e0 AS x, (180e0 - 180e0 / pi() * ln(tan(pi() / 4 + stop_lat * pi() / 360e0))) / 360e0 AS y FROM fx_stops WHERE stop_lat IS NOT NULL)
""")

ROOT = (-16.0, 32.0, 48.0, 96.0)


def quadtree_keys(spark, sf):
    d = fx(spark, sf, "fx_stops").filter("stop_lat is not null").select("version_id", "item_id", S.quad_path("stop_lon", "stop_lat", ROOT, 5).alias("p"))
    return d.select("version_id", "item_id", S.quad_key("p").alias("key"), S.quad_bbox("p", ROOT).alias("b")).select("version_id", "item_id", "key", "b.*")


QUADTREE_KEYS = whole("""
SELECT version_id, item_id, array_to_string(list_transform(range(5), lambda k: CASE WHEN (tx >> (4 - k)) & 1 = 1 THEN CASE WHEN (ty >> (4 - k)) & 1 = 1 THEN 'TR' ELSE 'BR' END ELSE CASE WHEN (ty >> (4 - k)) & 1 = 1 THEN 'TL' ELSE 'BL' END END), '_') AS key,
       -16e0 + tx * 2e0 AS min_x, 32e0 + ty * 2e0 AS min_y, -14e0 + tx * 2e0 AS max_x, 34e0 + ty * 2e0 AS max_y
FROM (SELECT *, CAST(floor((stop_lon + 16e0) / 2e0) AS BIGINT) AS tx, CAST(floor((stop_lat - 32e0) / 2e0) AS BIGINT) AS ty FROM fx_stops WHERE stop_lat IS NOT NULL)
""")


def quadtree_cover(spark, sf):
    d = fx(spark, sf, "fx_boxes")
    return S.quad_cover(d, "west", "south", "east", "north", (12.5, 51.5, 14.5, 53.5), 6).select(
        "feature_id", "tile_x", "tile_y", "key", S.quad_min_depth(F.col("east") - F.col("west"), F.col("north") - F.col("south"), 2.0, 2.0, F.lit(2), F.lit(3)).alias("min_depth"))


QUADTREE_COVER = whole("""
SELECT feature_id, tile_x, tile_y, array_to_string(list_transform(range(6), lambda k: CASE WHEN (tile_x >> (5 - k)) & 1 = 1 THEN CASE WHEN (tile_y >> (5 - k)) & 1 = 1 THEN 'TR' ELSE 'BR' END ELSE CASE WHEN (tile_y >> (5 - k)) & 1 = 1 THEN 'TL' ELSE 'BL' END END), '_') AS key,
       CASE WHEN east - west = 0 OR north - south = 0 THEN 0 ELSE greatest(CAST(ceil(log2(greatest(2 * 2e0 / (east - west), 1e0))) AS BIGINT), CAST(ceil(log2(greatest(3 * 2e0 / (north - south), 1e0))) AS BIGINT), 1) END AS min_depth
FROM fx_boxes, LATERAL (SELECT unnest(range(CAST(floor((west - 12.5e0) / 0.03125e0) AS BIGINT), CAST(ceil((east - 12.5e0) / 0.03125e0) AS BIGINT))) AS tile_x), LATERAL (SELECT unnest(range(CAST(floor((south - 51.5e0) / 0.03125e0) AS BIGINT), CAST(ceil((north - 51.5e0) / 0.03125e0) AS BIGINT))) AS tile_y)
WHERE tile_x BETWEEN 0 AND 63 AND tile_y BETWEEN 0 AND 63
""")


def segment_measures(spark, sf):
    d = fx(spark, sf, "fx_segments")
    return d.select(
        "segment_id", R9(S.seg_dist_sq(F.lit(0.5), F.lit(0.5), "ax", "ay", "bx", "by_"), "dist_sq"),
        S.seg_hits_box("ax", "ay", "bx", "by_", F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75)).alias("hits"),
        R9(S.seg_dist_sq("ax", "ay", "bx", "by_", "bx", "by_"), "length_sq"),
        F.round(S.haversine_m("ax", "ay", "bx", "by_"), 4).alias("meters"),
    )


SEGMENT_MEASURES = whole(f"""
SELECT segment_id, round(CASE WHEN l > 0 THEN (0.5e0 - ax - dx * t) ** 2 + (0.5e0 - ay - dy * t) ** 2 ELSE (0.5e0 - ax) ** 2 + (0.5e0 - ay) ** 2 END, 9) AS dist_sq,
       greatest(CASE WHEN dx <> 0 THEN least((0.25e0 - ax) / dx, (0.75e0 - ax) / dx) WHEN ax BETWEEN 0.25e0 AND 0.75e0 THEN 0 ELSE 2 END,
                CASE WHEN dy <> 0 THEN least((0.25e0 - ay) / dy, (0.75e0 - ay) / dy) WHEN ay BETWEEN 0.25e0 AND 0.75e0 THEN 0 ELSE 2 END, 0e0)
       <= least(CASE WHEN dx <> 0 THEN greatest((0.25e0 - ax) / dx, (0.75e0 - ax) / dx) WHEN ax BETWEEN 0.25e0 AND 0.75e0 THEN 1 ELSE -1 END,
                CASE WHEN dy <> 0 THEN greatest((0.25e0 - ay) / dy, (0.75e0 - ay) / dy) WHEN ay BETWEEN 0.25e0 AND 0.75e0 THEN 1 ELSE -1 END, 1e0) AS hits,
       round(l, 9) AS length_sq,
       round(2 * {S.EARTH_RADIUS} * asin(sqrt(sin(radians(by_ - ay) / 2) ** 2 + cos(radians(ay)) * cos(radians(by_)) * sin(radians(bx - ax) / 2) ** 2)), 4) AS meters
FROM (SELECT *, least(greatest(((0.5e0 - ax) * dx + (0.5e0 - ay) * dy) / nullif(l, 0), 0e0), 1e0) AS t FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy, (bx - ax) ** 2 + (by_ - ay) ** 2 AS l FROM fx_segments))
""")


def feature_ids(spark, sf):
    d = fx(spark, sf, "fx_boxes")
    name = F.concat(F.when(F.col("feature_id") % 2 == 0, "N").otherwise("S"), F.lpad((F.col("feature_id") % 80).cast("string"), 2, "0"), F.when(F.col("feature_id") % 3 == 0, "E").otherwise("W"), F.lpad((F.col("feature_id") % 170).cast("string"), 3, "0"))
    zone = F.concat(F.lpad((F.col("feature_id") % 60 + 1).cast("string"), 2, "0"), F.when(F.col("feature_id") % 5 == 0, "G").otherwise("T"), F.lit("QM"))
    d = d.select("feature_id", S.osm_id("feature_id").alias("o"), S.offset_bounds(name).alias("b"), S.utm_params(zone).alias("u"), S.dem_pack((F.col("feature_id") % 4000).cast("double")).alias("packed"))
    return d.select("feature_id", F.col("o.osm_type").alias("osm_type"), F.col("o.osm_key").alias("osm_key"), "b.west", "b.north", "u.central_meridian", "u.false_northing", "packed", F.round(S.dem_unpack("packed"), 4).alias("elevation"))


FEATURE_IDS = whole("""
SELECT feature_id, CASE feature_id % 10 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 4 THEN 'relation' END AS osm_type, CASE WHEN feature_id % 10 IN (0, 1, 4) THEN feature_id // 10 END AS osm_key,
       CASE WHEN feature_id % 3 = 0 THEN 1e0 ELSE -1e0 END * (feature_id % 170) AS west, CASE WHEN feature_id % 2 = 0 THEN 1e0 ELSE -1e0 END * (feature_id % 80) + 36e0 AS north,
       (feature_id % 60 + 1) * 6e0 - 183e0 AS central_meridian, CASE WHEN feature_id % 5 = 0 THEN 1e7 ELSE 0e0 END AS false_northing,
       CAST((feature_id % 4000 + 10000) * 10 AS INT) AS packed, CAST(feature_id % 4000 AS DOUBLE) AS elevation
FROM fx_boxes
""")


def hilbert_order(spark, sf):
    d = S.tiles_for_bounds(fx(spark, sf, "fx_boxes"), "west", "south", "east", "north", 12).select("x", "y").distinct()
    return d.select("x", "y", S.hilbert_id(12, "x", "y").alias("hilbert_id"))


QUERIES = {f.__name__: f for f in (tile_addresses, tiles_of_boxes, parsed_bounds, box_algebra, xyz_ranges, mercator_coordinates, quadtree_keys, quadtree_cover, segment_measures, feature_ids, hilbert_order)}
SQL = {"tile_addresses": TILE_ADDRESSES, "tiles_of_boxes": TILES_OF_BOXES, "parsed_bounds": PARSED_BOUNDS, "box_algebra": BOX_ALGEBRA, "xyz_ranges": XYZ_RANGES, "mercator_coordinates": MERCATOR_COORDINATES, "quadtree_keys": QUADTREE_KEYS, "quadtree_cover": QUADTREE_COVER, "segment_measures": SEGMENT_MEASURES, "feature_ids": FEATURE_IDS}
