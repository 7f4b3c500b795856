"""Spatial expressions: Column in, Column out, all inside generated code. Angles in degrees unless a name says radians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest latitude of the web Mercator square, as tile addresses use it.
MAX_LAT = 85.05112878
#: Largest latitude exactly, in radians.
MAX_LAT_RADIANS = math.atan(math.sinh(math.pi))
METERS_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6_371_008.8
EARTH_CIRCUMFERENCE = 2 * math.pi * EARTH_RADIUS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def tiles_per_side(z) -> Column:
    return F.pow(F.lit(2.0), _c(z)).cast("long")


def lon_to_tile_x(lon, z) -> Column:
    n = tiles_per_side(z)
    return clamp(F.floor((clamp(lon, F.lit(-180.0), F.lit(180.0)) + 180.0) / 360.0 * n), F.lit(0), n - 1).cast("int")


def lat_to_tile_y(lat, z) -> Column:
    n = tiles_per_side(z)
    r = F.radians(clamp(lat, F.lit(-MAX_LAT), F.lit(MAX_LAT)))
    return clamp(F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n), F.lit(0), n - 1).cast("int")


def tile_y_to_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * _c(y) / tiles_per_side(z)))))


def tile_bounds(z, x, y) -> Column:
    """struct<west, south, east, north>"""
    n = tiles_per_side(z)
    return F.struct(
        (_c(x) / n * 360.0 - 180.0).alias("west"), tile_y_to_lat(_c(y) + 1, z).alias("south"),
        ((_c(x) + 1) / n * 360.0 - 180.0).alias("east"), tile_y_to_lat(y, z).alias("north"),
    )


def tile_range(west, south, east, north, z) -> Column:
    """struct<min_x, max_x, min_y, max_y>; both edges by floor."""
    return F.struct(
        lon_to_tile_x(west, z).alias("min_x"), lon_to_tile_x(east, z).alias("max_x"),
        lat_to_tile_y(north, z).alias("min_y"), lat_to_tile_y(south, z).alias("max_y"),
    )


def tiles_for_bounds(df: DataFrame, west, south, east, north, z: int) -> DataFrame:
    """A row for each tile that a box touches: adds x, y."""
    r = tile_range(west, south, east, north, z)
    return df.withColumn("_r", r).withColumn("x", F.explode(F.sequence("_r.min_x", "_r.max_x"))).withColumn("y", F.explode(F.sequence("_r.min_y", "_r.max_y"))).drop("_r")


def count_tiles(west, south, east, north, z_min: int, z_max: int) -> Column:
    def at(z):
        return (lon_to_tile_x(east, z) - lon_to_tile_x(west, z) + 1).cast("long") * (lat_to_tile_y(south, z) - lat_to_tile_y(north, z) + 1)

    return F.aggregate(F.sequence(F.lit(z_min), F.lit(z_max)), F.lit(0).cast("long"), lambda a, z: a + at(z))


def parse_bounds(text) -> Column:
    """struct<west, south, east, north, valid> of ``w,s,e,n``; what is no number is null."""
    parts = F.split(_c(text), ",")
    at = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    w, s, e, n = at(0), at(1), at(2), at(3)
    valid = (F.size(parts) == 4) & bounds_valid(w, s, e, n)
    return F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"), F.coalesce(valid, F.lit(False)).alias("valid"))


def bounds_valid(west, south, east, north) -> Column:
    w, s, e, n = map(_c, (west, south, east, north))
    return (w >= -180.0) & (e <= 180.0) & (s >= -MAX_LAT) & (n <= MAX_LAT) & (w < e) & (s < n)


def expand_meters(west, south, east, north, meters) -> Column:
    w, s, e, n, m = map(_c, (west, south, east, north, meters))
    d_lat = m / METERS_PER_DEGREE
    d_lon = m / F.greatest(METERS_PER_DEGREE * F.abs(F.cos(F.radians((s + n) * 0.5))), F.lit(1.0))
    grown = F.struct(
        F.greatest(w - d_lon, F.lit(-180.0)).alias("west"), F.greatest(s - d_lat, F.lit(-MAX_LAT)).alias("south"),
        F.least(e + d_lon, F.lit(180.0)).alias("east"), F.least(n + d_lat, F.lit(MAX_LAT)).alias("north"),
    )
    return F.when(m > 0, grown).otherwise(F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")))


def intersects(a: str | Column, b: str | Column, inclusive: bool = False) -> Column:
    """Boxes as structs of west, south, east, north."""
    a, b = _c(a), _c(b)
    if inclusive:
        return (a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"])
    return (a["west"] < b["east"]) & (a["east"] > b["west"]) & (a["south"] < b["north"]) & (a["north"] > b["south"])


def contains_lon_lat(box, lon, lat) -> Column:
    b, x, y = _c(box), _c(lon), _c(lat)
    return (x >= b["west"]) & (x <= b["east"]) & (y >= b["south"]) & (y <= b["north"])


def tile_id(z, x, y) -> Column:
    return F.concat_ws("-", _c(z).cast("string"), _c(x).cast("string"), _c(y).cast("string"))


def xyz_tile_range(west, south, east, north, z) -> Column:
    """struct<x_min, x_max, y_min, y_max>; the far edges by ceil - 1, so a box that ends on a tile's edge stays out of the next tile."""
    n = tiles_per_side(z).cast("double")
    side = 2.0 * math.pi / n
    max_lat = math.degrees(MAX_LAT_RADIANS)
    x = lambda v: F.radians(clamp(v, F.lit(-180.0), F.lit(180.0)))
    y = lambda v: F.ln(F.tan(math.pi / 4 + F.radians(clamp(v, F.lit(-max_lat), F.lit(max_lat))) / 2.0))
    near = lambda v: clamp(F.floor(v), F.lit(0.0), n - 1).cast("int")
    far = lambda v: clamp(F.ceil(v) - 1, F.lit(0.0), n - 1).cast("int")
    return F.struct(
        near((x(west) + math.pi) / side).alias("x_min"), far((x(east) + math.pi) / side).alias("x_max"),
        near((math.pi - y(north)) / side).alias("y_min"), far((math.pi - y(south)) / side).alias("y_max"),
    )


def tile_bounds_radians(z, x, y) -> Column:
    """struct<min_x, min_y, max_x, max_y> of a tile on the Mercator plane."""
    side = 2.0 * math.pi / tiles_per_side(z).cast("double")
    return F.struct(
        (_c(x) * side - math.pi).alias("min_x"), (math.pi - (_c(y) + 1) * side).alias("min_y"),
        ((_c(x) + 1) * side - math.pi).alias("max_x"), (math.pi - _c(y) * side).alias("max_y"),
    )


def mercator(lon, lat, altitude=0.0) -> Column:
    """struct<x, y, z> in the unit square; altitude in metres."""
    return F.struct(
        ((_c(lon) + 180.0) / 360.0).alias("x"),
        ((180.0 - 180.0 / math.pi * F.ln(F.tan(math.pi / 4 + _c(lat) * math.pi / 360.0))) / 360.0).alias("y"),
        (_c(altitude) / (EARTH_CIRCUMFERENCE * F.cos(F.radians(_c(lat))))).alias("z"),
    )


def mercator_lat(y) -> Column:
    return 360.0 / math.pi * F.atan(F.exp((180.0 - _c(y) * 360.0) * math.pi / 180.0)) - 90.0


def mercator_to_lnglat(x, y, z=0.0) -> Column:
    """struct<lon, lat, altitude>"""
    lat = mercator_lat(y)
    return F.struct((_c(x) * 360.0 - 180.0).alias("lon"), lat.alias("lat"), (_c(z) * EARTH_CIRCUMFERENCE * F.cos(F.radians(lat))).alias("altitude"))


def mercator_scale(lat) -> Column:
    return 1.0 / F.cos(F.radians(_c(lat)))


def meters_unit(y) -> Column:
    """Mercator units of one metre."""
    return mercator_scale(mercator_lat(y)) / EARTH_CIRCUMFERENCE


def bounded_mercator(lon_radians, lat_radians, lat_min: float, lat_max: float) -> Column:
    """struct<x, y>: positions outside are moved to the edge first."""
    return F.struct(clamp(lon_radians, F.lit(-math.pi), F.lit(math.pi)).alias("x"), F.ln(F.tan(math.pi / 4 + clamp(lat_radians, F.lit(lat_min), F.lit(lat_max)) / 2.0)).alias("y"))


def approx_size(lon_min, lat_min, lon_max, lat_max) -> Column:
    """struct<width, height> in metres of an area in radians; the width on the wider of both parallels."""
    across = lambda lat: F.degrees(_c(lon_max) - _c(lon_min)) * METERS_PER_DEGREE * F.cos(_c(lat))
    return F.struct(F.greatest(across(lat_min), across(lat_max)).alias("width"), (F.degrees(_c(lat_max) - _c(lat_min)) * METERS_PER_DEGREE).alias("height"))


def box(west, south, east, north) -> Column:
    return F.struct(_c(west).alias("west"), _c(south).alias("south"), _c(east).alias("east"), _c(north).alias("north"))


def box_union(a, b) -> Column:
    a, b = _c(a), _c(b)
    return box(F.least(a["west"], b["west"]), F.least(a["south"], b["south"]), F.greatest(a["east"], b["east"]), F.greatest(a["north"], b["north"]))


def box_intersection(a, b) -> Column:
    """Null if the boxes share no point."""
    a, b = _c(a), _c(b)
    return F.when(intersects(a, b, True), box(F.greatest(a["west"], b["west"]), F.greatest(a["south"], b["south"]), F.least(a["east"], b["east"]), F.least(a["north"], b["north"])))


def box_center(a) -> Column:
    a = _c(a)
    return F.struct(((a["west"] + a["east"]) / 2.0).alias("lon"), ((a["south"] + a["north"]) / 2.0).alias("lat"))


def box_size(a) -> Column:
    a = _c(a)
    return F.struct((a["east"] - a["west"]).alias("width"), (a["north"] - a["south"]).alias("height"))


def box_expand(a, border) -> Column:
    a, d = _c(a), _c(border)
    return box(a["west"] - d, a["south"] - d, a["east"] + d, a["north"] + d)


def closest_point(a, lon, lat) -> Column:
    a = _c(a)
    return F.struct(clamp(lon, a["west"], a["east"]).alias("lon"), clamp(lat, a["south"], a["north"]).alias("lat"))


def quad_path(x, y, area: tuple[float, float, float, float], depth: int) -> Column:
    """Quadtree path of a point as an array of BL, BR, TR, TL; a point on a middle line goes right or up. ``area``: min x, min y, max x, max y."""
    x0, y0, x1, y1 = area
    step = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    rx = lambda k: F.pmod(_c(x) - x0, F.lit(x1 - x0) / step(k - 1)) >= F.lit(x1 - x0) / step(k)
    ry = lambda k: F.pmod(_c(y) - y0, F.lit(y1 - y0) / step(k - 1)) >= F.lit(y1 - y0) / step(k)
    return F.transform(
        F.sequence(F.lit(1), F.lit(depth)),
        lambda k: F.when(rx(k) & ry(k), "TR").when(rx(k), "BR").when(ry(k), "TL").otherwise("BL"),
    )


def quad_key(path) -> Column:
    return F.array_join(_c(path), "_")


def quad_bbox(path, area: tuple[float, float, float, float]) -> Column:
    """struct<min_x, min_y, max_x, max_y> of a quadtree path."""
    x0, y0, x1, y1 = area
    start = F.struct(F.lit(float(x0)).alias("x"), F.lit(float(y0)).alias("y"), F.lit(float(x1 - x0)).alias("w"), F.lit(float(y1 - y0)).alias("h"))
    at = F.aggregate(
        _c(path), start,
        lambda a, k: F.struct(
            (a["x"] + F.when(F.substring(k, 2, 1) == "R", a["w"] / 2).otherwise(0.0)).alias("x"),
            (a["y"] + F.when(F.substring(k, 1, 1) == "T", a["h"] / 2).otherwise(0.0)).alias("y"),
            (a["w"] / 2).alias("w"), (a["h"] / 2).alias("h"),
        ),
        lambda a: F.struct(a["x"].alias("min_x"), a["y"].alias("min_y"), (a["x"] + a["w"]).alias("max_x"), (a["y"] + a["h"]).alias("max_y")),
    )
    return at


def quad_cover(df: DataFrame, min_x, min_y, max_x, max_y, area: tuple[float, float, float, float], depth: int) -> DataFrame:
    """A row for each tile of ``depth`` that covers a row's box and has its centre in the root: adds key, tile_x, tile_y (from the root's corner)."""
    x0, y0, x1, y1 = map(float, area)
    w, h = (x1 - x0) / 2**depth, (y1 - y0) / 2**depth
    first = lambda v, o, s: F.floor((_c(v) - o) / s)
    last = lambda v, o, s: F.ceil((_c(v) - o) / s) - 1
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("tile_x", F.explode(steps(first(min_x, x0, w), last(max_x, x0, w)))).withColumn("tile_y", F.explode(steps(first(min_y, y0, h), last(max_y, y0, h))))
    out = out.filter(F.col("tile_x").between(0, 2**depth - 1) & F.col("tile_y").between(0, 2**depth - 1))
    return out.withColumn("key", quad_key(quad_path(x0 + (F.col("tile_x") + 0.5) * w, y0 + (F.col("tile_y") + 0.5) * h, area, depth)))


def quad_keys(df: DataFrame, depth) -> DataFrame:
    """A row for each of the 4 ** depth keys of a row's ``depth`` (a column or a number): adds key; depth 0 has the empty key alone."""
    corner = F.array(*map(F.lit, ("BL", "BR", "TR", "TL")))
    place = df.withColumn("_d", _c(depth) if not isinstance(depth, int) else F.lit(depth)).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(4.0), F.col("_d")).cast("long") - 1)))
    # The digits of a number to base 4, the highest first, are the corners on the way down.
    steps = F.filter(F.sequence(F.lit(1), F.greatest(F.col("_d"), F.lit(1))), lambda k: k <= F.col("_d"))
    path = F.transform(steps, lambda k: F.get(corner, (F.floor(F.col("_n") / F.pow(F.lit(4.0), F.col("_d") - k)) % 4).cast("int")))
    return place.withColumn("key", quad_key(path)).drop("_d", "_n")


def quad_min_depth(area_w, area_h, root_w: float, root_h: float, nx, ny) -> Column:
    """Smallest depth at which an area has nx by ny tiles; 0 for an empty area, else 1 at least."""
    d = lambda n, root, size: F.ceil(F.log2(F.greatest(_c(n) * root / _c(size), F.lit(1.0))))
    return F.when((_c(area_w) == 0) | (_c(area_h) == 0), F.lit(0).cast("long")).otherwise(F.greatest(d(nx, root_w, area_w), d(ny, root_h, area_h), F.lit(1).cast("long")))


def quad_area_size(root: float, depth, count) -> Column:
    return F.lit(root) * _c(count) / F.pow(F.lit(2.0), _c(depth))


def tile_to_lnglat(z, x, y, px, py, extent: int = 4096) -> Column:
    """struct<lon, lat> of tile-local coordinates (y down)."""
    n = tiles_per_side(z).cast("double")
    return F.struct(
        ((_c(x) + _c(px) / extent) / n * 360.0 - 180.0).alias("lon"),
        F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (_c(y) + _c(py) / extent) / n)))).alias("lat"),
    )


def ring_crosses(px, py, ax, ay, bx, by) -> Column:
    """Whether the ray to the right of (px, py) crosses the edge a-b; an even sum over all rings of a polygon is outside."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)


def seg_dist_sq(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point and a segment; a segment without length is a point."""
    px, py, ax, ay, bx, by = map(_c, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, clamp(((px - ax) * dx + (py - ay) * dy) / length, F.lit(0.0), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - (ax + dx * t), py - (ay + dy * t)
    return ex * ex + ey * ey


def seg_hits_box(ax, ay, bx, by, min_x, min_y, max_x, max_y) -> Column:
    """Whether a segment and a box share a point: the spans of the segment within both slabs overlap."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))

    def slab(a, b, lo, hi):
        d = b - a
        lo, hi = _c(lo), _c(hi)
        t, u = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        inside = (a >= lo) & (a <= hi)
        return (
            F.when(d != 0, F.least(t, u)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)),
            F.when(d != 0, F.greatest(t, u)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)),
        )

    (t0, t1), (u0, u1) = slab(ax, bx, min_x, max_x), slab(ay, by, min_y, max_y)
    return F.greatest(t0, u0, F.lit(0.0)) <= F.least(t1, u1, F.lit(1.0))


def offset_bounds(name) -> Column:
    """36 degree cell of a name such as N18E000; null without such a part."""
    p = r"([NS])(\d+)([EW])(\d+)"
    g = lambda k: F.regexp_extract(_c(name), p, k)
    lat = F.when(g(1) == "S", -g(2).cast("double")).otherwise(g(2).cast("double"))
    lon = F.when(g(3) == "W", -g(4).cast("double")).otherwise(g(4).cast("double"))
    return F.when(_c(name).rlike(p), box(lon, lat, lon + 36.0, lat + 36.0))


def utm_params(mgrs) -> Column:
    """struct<central_meridian, false_easting, false_northing> of a grid zone such as 32TQM; bands from N on are north."""
    zone, band = F.regexp_extract(_c(mgrs), r"^(\d{1,2})([C-X])", 1), F.regexp_extract(_c(mgrs), r"^(\d{1,2})([C-X])", 2)
    return F.when(
        band != "",
        F.struct((zone.cast("double") * 6.0 - 183.0).alias("central_meridian"), F.lit(500_000.0).alias("false_easting"), F.when(band >= "N", 0.0).otherwise(10_000_000.0).alias("false_northing")),
    )


def dem_unpack(packed, red: float = 6553.6, green: float = 25.6, blue: float = 0.1, shift: float = 10_000.0) -> Column:
    """Elevation of a 24-bit pixel."""
    p = _c(packed).cast("int")
    byte = lambda k: F.shiftright(p, k).bitwiseAND(F.lit(255)).cast("double")
    return byte(16) * red + byte(8) * green + byte(0) * blue - shift


def dem_pack(v, red: float = 6553.6, green: float = 25.6, blue: float = 0.1, shift: float = 10_000.0) -> Column:
    """24-bit pixel of an elevation."""
    least = min(red, green, blue)
    scaled = F.round((_c(v) + shift) / least)
    byte = lambda f: F.pmod(F.floor(scaled * least / f), F.lit(256)).cast("int")
    return F.shiftleft(byte(red), 16).bitwiseOR(F.shiftleft(byte(green), 8)).bitwiseOR(byte(blue))


def geom_bbox(positions) -> Column:
    """Box of an array of positions (arrays of numbers); positions with fewer than two numbers are left out, none gives null."""
    good = F.filter(_c(positions), lambda p: F.size(p) >= 2)
    xs, ys = F.transform(good, lambda p: p[0]), F.transform(good, lambda p: p[1])
    return F.when(F.size(good) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def osm_id(feature_id) -> Column:
    """struct<osm_type, osm_key> of a tile feature id, null for other last digits."""
    last = _c(feature_id) % 10
    kind = F.when(last == 0, "node").when(last == 1, "way").when(last == 4, "relation")
    return F.when(kind.isNotNull(), F.struct(kind.alias("osm_type"), F.floor(_c(feature_id) / 10).cast("long").alias("osm_key")))


def normal_lon(lon) -> Column:
    return F.pmod(_c(lon) + 180.0, F.lit(360.0)) - 180.0


def utc_offset_minutes(lon) -> Column:
    """Nominal offset from UTC by longitude: whole hours of 15 degrees, halves up."""
    return clamp(F.floor(normal_lon(lon) / 15.0 + 0.5) * 60, F.lit(-720), F.lit(840)).cast("int")


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def hilbert_id(z: int, x, y) -> Column:
    """Position of a tile on the Hilbert curves of all zooms in a row; ``z`` is one zoom, so the bit steps are one expression."""
    a, b = _c(x).cast("long"), _c(y).cast("long")
    start = F.struct(a.alias("x"), b.alias("y"), F.lit((4**z - 1) // 3).cast("long").alias("d"))
    steps = F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(z))])

    def step(s, n):
        rx, ry = F.when(s["x"].bitwiseAND(n) > 0, 1).otherwise(0), F.when(s["y"].bitwiseAND(n) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, n - 1 - s["x"]).otherwise(s["x"]), F.when(flip, n - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).alias("x"), F.when(ry == 0, x).otherwise(y).alias("y"), (s["d"] + n * n * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(steps, start, step, lambda s: s["d"]) if z else F.lit(0).cast("long")
