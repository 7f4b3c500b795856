"""Rasters as pixel tables: one row a pixel, images joined by position."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial as S

NO_DATA = -32768


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def as_i16(dn) -> Column:
    """Unsigned 16-bit values read as signed ones."""
    return F.when(_c(dn) > 32767, _c(dn) - 65536).otherwise(_c(dn)).cast("int")


def raster_mode(has_sidecar, name) -> Column:
    return F.when(_c(has_sidecar), "footprint").when(_c(name).rlike(r"[NS]\d+[EW]\d+"), "offset").otherwise("error")


def check_band_dims(bands: DataFrame) -> DataFrame:
    """Tiles whose bands differ in size."""
    size = bands.groupBy("tile_id", "band").agg(F.max("row_no").alias("h"), F.max("col_no").alias("w"))
    return size.groupBy("tile_id").agg(F.count_distinct("h", "w").alias("sizes")).filter("sizes > 1")


def stack_bands(bands: DataFrame) -> DataFrame:
    """(tile_id, row_no, col_no, r, g, b, a) of bands 0, 1, 2: 2.5 / 10000 of full scale, cut off and clamped; a pixel without data in any band is all zero."""
    dn = as_i16("dn")
    tone = F.least(F.greatest(F.lit(255.0).cast("float") * F.lit(2.5).cast("float") * dn.cast("float") / F.lit(10000.0).cast("float"), F.lit(0.0).cast("float")), F.lit(255.0).cast("float")).cast("int")
    of = lambda b, c: F.max(F.when(F.col("band") == b, c))
    px = bands.groupBy("tile_id", "row_no", "col_no").agg(of(0, tone).alias("r"), of(1, tone).alias("g"), of(2, tone).alias("b"), F.max((dn == NO_DATA).cast("int")).alias("_none"))
    blank = F.col("_none") == 1
    return px.select("tile_id", "row_no", "col_no", *[F.when(blank, 0).otherwise(F.col(c)).alias(c) for c in "rgb"], F.when(blank, 0).otherwise(255).alias("a"))


def footprint_bounds(ring) -> Column:
    """Box of a ring of (lon, lat) arrays."""
    return S.geom_bbox(ring)


def clip_interest(manifest: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return manifest.filter(S.intersects("bounds", S.box(F.lit(west), F.lit(south), F.lit(east), F.lit(north)), True))


def smallest_divisor(n, most: int) -> Column:
    """Smallest divisor d of n with n / d <= most."""
    n = _c(n).cast("int")
    return F.array_min(F.filter(F.sequence(F.lit(1), n), lambda d: (n % d == 0) & (n / d <= most)))


def split_tiles(px: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Pixels with their sub-tile (i from the west, j from the south) and place in it; ``sizes``: tile_id, width, height."""
    s = sizes.withColumn("_dw", smallest_divisor("width", most)).withColumn("_dh", smallest_divisor("height", most))
    out = px.join(s, "tile_id").withColumn("_w", (F.col("width") / F.col("_dw")).cast("int")).withColumn("_h", (F.col("height") / F.col("_dh")).cast("int"))
    i, j = F.floor(F.col("col_no") / F.col("_w")).cast("int"), (F.col("_dh") - 1 - F.floor(F.col("row_no") / F.col("_h"))).cast("int")
    return out.select(
        "tile_id", i.alias("i"), j.alias("j"), F.concat_ws("_", F.col("tile_id").cast("string"), i.cast("string"), j.cast("string")).alias("name"),
        (F.col("row_no") % F.col("_h")).alias("row_no"), (F.col("col_no") % F.col("_w")).alias("col_no"), *[c for c in "rgba"],
    )


def split_bounds(manifest: DataFrame, most: int) -> DataFrame:
    """(tile_id, name, i, j, bounds) of the sub-tiles that ``split_tiles`` makes of images (tile_id, bounds, width, height); row j = 0 is the southern one."""
    s = manifest.withColumn("_dw", smallest_divisor("width", most)).withColumn("_dh", smallest_divisor("height", most))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_dw") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_dh") - 1)))
    at = lambda a, b, k, n: F.col(f"bounds.{a}") + (F.col(f"bounds.{b}") - F.col(f"bounds.{a}")) * k / n
    box = S.box(at("west", "east", F.col("i"), F.col("_dw")), at("south", "north", F.col("j"), F.col("_dh")), at("west", "east", F.col("i") + 1, F.col("_dw")), at("south", "north", F.col("j") + 1, F.col("_dh")))
    return s.select("tile_id", F.concat_ws("_", F.col("tile_id").cast("string"), F.col("i").cast("string"), F.col("j").cast("string")).alias("name"), "i", "j", box.alias("bounds"))


def _corners(px: DataFrame, keys: list[str]) -> DataFrame:
    """Each pixel with its right, lower and lower right neighbours; edges repeat themselves. Two windows, no self-join."""
    vals = [c for c in px.columns if c not in (*keys, "row_no", "col_no")]
    right = Window.partitionBy(*keys, "row_no").orderBy("col_no")
    below = Window.partitionBy(*keys, "col_no").orderBy("row_no")
    p = px.withColumn("v00", F.struct(*vals)).withColumn("v01", F.coalesce(F.lead(F.struct(*vals)).over(right), F.struct(*vals)))
    p = p.withColumn("v10", F.coalesce(F.lead("v00").over(below), F.col("v00"))).withColumn("v11", F.coalesce(F.lead("v01").over(below), F.col("v01")))
    return p.select(*keys, "row_no", "col_no", "v00", "v01", "v10", "v11")


def bilinear(points: DataFrame, px: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Values of ``bands`` at positions (fx, fy) in pixels, 0 at the first pixel's centre: one join on the pixel up and left of a position. Positions outside move to the edge."""
    size = px.groupBy(*keys).agg(F.max("row_no").alias("_h"), F.max("col_no").alias("_w"))
    at = points.join(size, keys)
    at = at.withColumn("fx", F.least(F.greatest("fx", F.lit(0.0)), F.col("_w").cast("double"))).withColumn("fy", F.least(F.greatest("fy", F.lit(0.0)), F.col("_h").cast("double")))
    at = at.withColumn("row_no", F.floor("fy").cast("int")).withColumn("col_no", F.floor("fx").cast("int"))
    met = at.join(_corners(px, keys), [*keys, "row_no", "col_no"])
    u, v = F.col("fx") - F.col("col_no"), F.col("fy") - F.col("row_no")
    mix = lambda b: (F.col(f"v00.{b}") * (1 - u) + F.col(f"v01.{b}") * u) * (1 - v) + (F.col(f"v10.{b}") * (1 - u) + F.col(f"v11.{b}") * u) * v
    return met.select(*points.columns, *[mix(b).alias(b) for b in bands])


def _in_cells(df: DataFrame, box: str, cell: float) -> DataFrame:
    """A row for each cell of a grid of ``cell`` degrees that a box touches: adds _cx, _cy."""
    at = lambda c: F.floor(F.col(f"{box}.{c}") / cell).cast("int")
    return df.withColumn("_cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("_cy", F.explode(F.sequence(at("south"), at("north"))))


def mosaic(px: DataFrame, manifest: DataFrame, requests: DataFrame, cols: int, rows: int, cell: float = 4.0) -> DataFrame:
    """Output pixels (request, row_no, col_no, r, g, b, a) of requests (request, area: box), ``cols`` by ``rows`` each.

    Sources (tile_id, path, bounds, width, height) that share area with a request are sampled bilinearly at the pixel
    centres inside them and blended over one another by alpha in the order of their path. Pixels of no source are left out.
    Requests and sources meet by the cells of ``cell`` degrees that they touch; a pair counts at the first cell of both.
    """
    area = lambda b: F.struct((F.col(f"{b}.east") - F.col(f"{b}.west")).alias("w"), (F.col(f"{b}.north") - F.col(f"{b}.south")).alias("h"))
    met = _in_cells(requests, "area", cell).join(_in_cells(manifest, "bounds", cell), ["_cx", "_cy"]).filter(S.intersects("area", "bounds"))
    first = lambda c: F.greatest(F.floor(F.col(f"area.{c}") / cell), F.floor(F.col(f"bounds.{c}") / cell))
    met = met.filter((F.col("_cx") == first("west")) & (F.col("_cy") == first("south"))).drop("_cx", "_cy")
    met = met.withColumn("_a", area("area")).withColumn("_b", area("bounds"))
    grid = met.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    x = F.col("area.west") + (F.col("col_no") + 0.5) / cols * F.col("_a.w")
    y = F.col("area.north") - (F.col("row_no") + 0.5) / rows * F.col("_a.h")
    grid = grid.withColumn("_x", x).withColumn("_y", y).filter(S.contains_lon_lat("bounds", "_x", "_y"))
    grid = grid.select(
        "request", "tile_id", "path", F.col("row_no").alias("out_row"), F.col("col_no").alias("out_col"),
        ((F.col("_x") - F.col("bounds.west")) / F.col("_b.w") * F.col("width") - 0.5).alias("fx"), ((F.col("bounds.north") - F.col("_y")) / F.col("_b.h") * F.col("height") - 0.5).alias("fy"),
    )
    got = bilinear(grid, px, ["tile_id"], ["r", "g", "b", "a"])
    layers = got.groupBy("request", "out_row", "out_col").agg(F.array_sort(F.collect_list(F.struct("path", "r", "g", "b", "a"))).alias("l"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def over(under, top):
        t = top["a"] / 255.0
        u = under["a"] / 255.0 * (1 - t)
        total = t + u
        blend = lambda c: F.when(total > 0, (top[c] * t + under[c] * u) / total).otherwise(0.0)
        return F.struct(*[blend(c).alias(c) for c in "rgb"], (total * 255.0).alias("a"))

    flat = layers.withColumn("p", F.aggregate("l", zero, over))
    return flat.select("request", F.col("out_row").alias("row_no"), F.col("out_col").alias("col_no"), *[F.round(f"p.{c}").cast("int").alias(c) for c in "rgba"])


def mosaic_bounds(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.min("bounds.west").alias("west"), F.min("bounds.south").alias("south"), F.max("bounds.east").alias("east"), F.max("bounds.north").alias("north"))


def tile_size(px: DataFrame) -> int:
    """Pixels a side, from full tiles."""
    return (px.agg(F.max(F.greatest("row_no", "col_no"))).first()[0] or 0) + 1


def parent_tiles(px: DataFrame, how: str = "box", size: int | None = None) -> DataFrame:
    """Tiles (z, x, y, pixels) of the next zoom out: each child shrunk to half; missing children are transparent. ``box`` averages 2 by 2, ``nearest``
    takes the first, ``triangle`` weighs four by four pixels of the child by 1, 3, 3, 1 each way (those beyond its edge have no weight).

    ``size``: pixels a side; needed where no tile is full."""
    p, half = px, (size or tile_size(px)) // 2
    place = lambda tile, at: ((F.col(tile) % 2) * half + F.floor(F.col(at) / 2)).cast("int")
    key = [(F.col("z") - 1).alias("z"), F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y"), place("y", "row_no").alias("row_no"), place("x", "col_no").alias("col_no")]
    if how == "nearest":
        return p.filter("row_no % 2 = 0 and col_no % 2 = 0").select(*key, *"rgba")
    if how == "triangle":
        # A pixel goes to its own half-size pixel with weight 3 and to the next one on its side with weight 1.
        def taps(at):
            own, other = F.floor(F.col(at) / 2), F.floor(F.col(at) / 2) + F.when(F.col(at) % 2 == 0, -1).otherwise(1)
            both = F.array(F.struct(own.alias("k"), F.lit(3).alias("w")), F.struct(other.alias("k"), F.lit(1).alias("w")))
            return F.explode(F.filter(both, lambda t: (t["k"] >= 0) & (t["k"] < half)))

        spread = p.withColumn("_r", taps("row_no")).withColumn("_c", taps("col_no")).withColumn("_w", F.col("_r.w") * F.col("_c.w"))
        place = lambda tile, k: ((F.col(tile) % 2) * half + F.col(k)).cast("int")
        key = [*key[:3], place("y", "_r.k").alias("row_no"), place("x", "_c.k").alias("col_no")]
        return spread.groupBy(*key).agg(*[F.floor(F.sum(F.col(c) * F.col("_w")) / F.sum("_w") + 0.5).cast("int").alias(c) for c in "rgba"])
    return p.groupBy(*key).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "rgba"])


def base_tiles(manifest: DataFrame, zoom: int) -> DataFrame:
    """Distinct tiles that the sources' bounds touch with some area."""
    r = manifest.withColumn("_r", S.xyz_tile_range("bounds.west", "bounds.south", "bounds.east", "bounds.north", zoom))
    return r.withColumn("x", F.explode(F.sequence("_r.x_min", "_r.x_max"))).withColumn("y", F.explode(F.sequence("_r.y_min", "_r.y_max"))).select(F.lit(zoom).alias("z"), "x", "y").distinct()


def to_web_mercator(px: DataFrame, manifest: DataFrame, tiles: DataFrame, size: int, cell: float = 4.0) -> DataFrame:
    """Pixels of Mercator tiles from images in degrees: latitude is not linear in a tile's rows, so each output pixel has its own.

    Tiles meet the images that their boxes touch by cells of ``cell`` degrees; pixels are made for those pairs alone.
    """
    boxed = tiles.withColumn("_t", S.tile_bounds("z", "x", "y"))
    met = _in_cells(boxed, "_t", cell).join(_in_cells(manifest, "bounds", cell), ["_cx", "_cy"]).filter(S.intersects("_t", "bounds"))
    first = lambda c: F.greatest(F.floor(F.col(f"_t.{c}") / cell), F.floor(F.col(f"bounds.{c}") / cell))
    met = met.filter((F.col("_cx") == first("west")) & (F.col("_cy") == first("south"))).drop("_cx", "_cy")
    met = met.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    met = met.withColumn("_l", S.tile_to_lnglat("z", "x", "y", F.col("col_no") + 0.5, F.col("row_no") + 0.5, size)).filter(S.contains_lon_lat("bounds", "_l.lon", "_l.lat"))
    pos = met.select(
        "z", "x", "y", F.col("row_no").alias("out_row"), F.col("col_no").alias("out_col"), "tile_id", "path",
        ((F.col("_l.lon") - F.col("bounds.west")) / (F.col("bounds.east") - F.col("bounds.west")) * F.col("width") - 0.5).alias("fx"),
        ((F.col("bounds.north") - F.col("_l.lat")) / (F.col("bounds.north") - F.col("bounds.south")) * F.col("height") - 0.5).alias("fy"),
    )
    got = bilinear(pos, px, ["tile_id"], ["r", "g", "b", "a"])
    top = got.groupBy("z", "x", "y", "out_row", "out_col").agg(F.max_by(F.struct("r", "g", "b", "a"), "path").alias("p"))
    return top.select("z", "x", "y", F.col("out_row").alias("row_no"), F.col("out_col").alias("col_no"), *[F.round(f"p.{c}").cast("int").alias(c) for c in "rgba"])


def xyz_pyramid(px: DataFrame, levels: int) -> list[DataFrame]:
    """Tiles of each zoom from the base (z, x, y, pixels) up to ``levels`` zooms further out."""
    out, size = [px], tile_size(px)
    for _ in range(levels):
        out.append(parent_tiles(out[-1], size=size))
    return out


#: Longitudes and latitudes of the root of the quadtree.
WORLD = (-180.0, -90.0, 180.0, 90.0)
QUAD = "level int, key string, tile_x long, tile_y long, row_no int, col_no int, r int, g int, b int, a int"


def quad_requests(manifest: DataFrame, depth: int, area: tuple[float, float, float, float] = WORLD) -> DataFrame:
    """(key, tile_x, tile_y, bounds) of the tiles of ``depth`` that share area with an image; the root's key is ``R``."""
    x0, y0, x1, y1 = area
    w, h = (x1 - x0) / 2**depth, (y1 - y0) / 2**depth
    if depth:
        found = S.quad_cover(manifest.select("bounds"), "bounds.west", "bounds.south", "bounds.east", "bounds.north", area, depth)
    else:
        inside = (F.col("bounds.east") > x0) & (F.col("bounds.west") < x1) & (F.col("bounds.north") > y0) & (F.col("bounds.south") < y1)
        found = manifest.filter(inside).select(F.lit(0).cast("long").alias("tile_x"), F.lit(0).cast("long").alias("tile_y"), F.lit("R").alias("key"))
    at = lambda o, t, s: F.lit(o) + F.col(t) * s
    box = S.box(at(x0, "tile_x", w), at(y0, "tile_y", h), at(x0 + w, "tile_x", w), at(y0 + h, "tile_y", h))
    return found.select("key", "tile_x", "tile_y").distinct().withColumn("bounds", box)


def quad_pyramid(px: DataFrame, manifest: DataFrame, size: int, depth: int, path: str, area: tuple[float, float, float, float] = WORLD) -> DataFrame:
    """Tiles of a quadtree over degrees, ``size`` pixels a side, written below ``path`` and read back: (level, key, tile_x, tile_y, pixels).

    The deepest level is sampled from the images (tile_id, path, bounds, width, height) that overlap a tile, each further one from the
    tiles of the level below, bilinearly and blended in the order of paths. A tile exists where an image does; its pixels that no image
    covers are transparent. Levels are written one after the other. Tiles that are found below ``path`` are not made again, so
    a pyramid that was broken off goes on where it stopped; a level's new tiles appear all at once.
    """
    spark = px.sparkSession
    schema = ", ".join(c for c in QUAD.split(", ") if not c.startswith("level"))

    def stored(level: int) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/level={level}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    for level in range(depth, -1, -1):
        tiles = pending(quad_requests(manifest, level, area), stored(level).select("key").distinct(), ["key"])
        got = mosaic(px, manifest, tiles.select(F.col("key").alias("request"), F.col("bounds").alias("area")), size, size, cell=max(4.0, (area[2] - area[0]) / 2**level)).withColumnRenamed("request", "key")
        grid = tiles.select("key", "tile_x", "tile_y", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("row_no")).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        whole = grid.join(got, ["key", "row_no", "col_no"], "left").select("key", "tile_x", "tile_y", "row_no", "col_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgba"])
        whole.write.mode("append").parquet(f"{path}/level={level}")
        px = stored(level).withColumnRenamed("key", "tile_id").drop("tile_x", "tile_y")
        made = stored(level).select("key", "tile_x", "tile_y").distinct()
        w, h = (area[2] - area[0]) / 2**level, (area[3] - area[1]) / 2**level
        bounds = S.box(F.lit(area[0]) + F.col("tile_x") * w, F.lit(area[1]) + F.col("tile_y") * h, F.lit(area[0] + w) + F.col("tile_x") * w, F.lit(area[1] + h) + F.col("tile_y") * h)
        manifest = made.select(F.col("key").alias("tile_id"), F.col("key").alias("path"), bounds.alias("bounds"), F.lit(size).alias("width"), F.lit(size).alias("height"))
    return spark.read.schema(QUAD).parquet(path)


def tilejson(tiles: DataFrame, name: str) -> DataFrame:
    """One row: TileJSON text with zooms and bounds inside the Mercator limits."""
    b = tiles.withColumn("_b", S.tile_bounds("z", "x", "y"))
    one = b.agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"), F.round(F.min("_b.west"), 6).alias("w"), F.round(F.greatest(F.min("_b.south"), F.lit(-S.MAX_LAT)), 6).alias("s"), F.round(F.max("_b.east"), 6).alias("e"), F.round(F.least(F.max("_b.north"), F.lit(S.MAX_LAT)), 6).alias("n"))
    return one.select(F.to_json(F.struct(F.lit("3.0.0").alias("tilejson"), F.lit(name).alias("name"), F.lit("xyz").alias("scheme"), "minzoom", "maxzoom", F.array("w", "s", "e", "n").alias("bounds"))).alias("json"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no completion mark names."""
    return work.join(done.select(*keys), keys, "left_anti")


def tile_window(px: DataFrame, left: int, top: int, right: int, bottom: int, width: int, height: int) -> DataFrame:
    """Pixels of a window [left, right) by [top, bottom) of an image that is cut into tiles (tx, ty) of width by height."""
    x, y = F.col("tx") * width + F.col("col_no"), F.col("ty") * height + F.col("row_no")
    tiles = F.col("tx").between(left // width, (right - 1) // width) & F.col("ty").between(top // height, (bottom - 1) // height)
    return px.filter(tiles).withColumn("wx", x - left).withColumn("wy", y - top).filter((F.col("wx") >= 0) & (F.col("wx") < right - left) & (F.col("wy") >= 0) & (F.col("wy") < bottom - top))


def with_halo(px: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of tiles (tx, ty) with the first column of the tile to the right, the first row of the tile below, and the corner pixel of
    the one below on the right: what bilinear sampling next to an edge reads. Each edge pixel is sent to its neighbours once."""
    left, up = (F.col("col_no") == 0) & (F.col("tx") > 0), (F.col("row_no") == 0) & (F.col("ty") > 0)
    to = lambda dx, dy: F.struct((F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty"), (F.col("row_no") + dy * height).alias("row_no"), (F.col("col_no") + dx * width).alias("col_no"))
    copies = F.array_compact(F.array(to(0, 0), F.when(left, to(1, 0)), F.when(up, to(0, 1)), F.when(left & up, to(1, 1))))
    values = [c for c in px.columns if c not in ("tx", "ty", "row_no", "col_no")]
    return px.select(*values, F.inline(copies))


def tile_resample(px: DataFrame, windows: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, tiles_x: int, tiles_y: int, cols: int, rows: int, bands: str = "rgb") -> DataFrame:
    """Pixels (request, row_no, col_no, bands) of world windows (request, area: box), ``cols`` by ``rows`` each, of an image that is cut into
    ``tiles_x`` by ``tiles_y`` tiles (tx, ty, from the north-west) of ``width`` by ``height`` and fills ``bounds`` (west, south, east, north).

    Values are bilinear at the centres of output pixels. A window reads from the pixel of its north-west corner to the one after
    its south-east corner, and what lies beyond those is the edge pixel. Tiles exchange edge pixels first, so each
    position needs the pixels of one tile; where a tile is not there its neighbour's edge repeats, and positions in it give no pixel.
    """
    west, south, east, north = bounds
    across, down = width * tiles_x, height * tiles_y
    px_x = lambda lon: (lon - west) / (east - west) * across
    px_y = lambda lat: (1.0 - (lat - south) / (north - south)) * down
    low = lambda c: F.greatest(F.floor(c), F.lit(0)).cast("long")
    high = lambda c, n: F.least(F.floor(c) + 1, F.lit(n - 1)).cast("long")
    w = windows.select(
        "request", "area", low(px_x(F.col("area.west"))).alias("_x0"), low(px_y(F.col("area.north"))).alias("_y0"),
        high(px_x(F.col("area.east")), across).alias("_x1"), high(px_y(F.col("area.south")), down).alias("_y1"),
    )
    at = w.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    lon = F.col("area.west") + (F.col("area.east") - F.col("area.west")) * ((F.col("col_no") + 0.5) / cols)
    lat = F.col("area.south") + (F.col("area.north") - F.col("area.south")) * ((F.lit(rows) - F.col("row_no") - 1 + 0.5) / rows)
    within = lambda c, lo, hi: F.least(F.greatest(c - 0.5, F.col(lo).cast("double")), F.col(hi).cast("double"))
    at = at.select("request", F.col("row_no").alias("_row"), F.col("col_no").alias("_col"), within(px_x(lon), "_x0", "_x1").alias("_fx"), within(px_y(lat), "_y0", "_y1").alias("_fy"))
    at = at.withColumn("_gx", F.floor("_fx").cast("int")).withColumn("_gy", F.floor("_fy").cast("int"))
    at = at.select("*", F.floor(F.col("_gx") / width).cast("int").alias("tx"), F.floor(F.col("_gy") / height).cast("int").alias("ty"), (F.col("_gx") % width).alias("col_no"), (F.col("_gy") % height).alias("row_no"))
    met = at.join(_corners(with_halo(px.select("tx", "ty", "row_no", "col_no", *bands), width, height), ["tx", "ty"]), ["tx", "ty", "row_no", "col_no"])
    u, v = F.col("_fx") - F.col("_gx"), F.col("_fy") - F.col("_gy")
    mix = lambda b: (F.col(f"v00.{b}") * (1 - u) + F.col(f"v01.{b}") * u) * (1 - v) + (F.col(f"v10.{b}") * (1 - u) + F.col(f"v11.{b}") * u) * v
    return met.select("request", F.col("_row").alias("row_no"), F.col("_col").alias("col_no"), *[F.round(mix(b)).cast("int").alias(b) for b in bands])


def elevation_at(points: DataFrame, dem: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """Points (tile_id, u, v in 0..1) with the bilinear elevation of their tile; points outside 0..1 are left out."""
    size = dem.groupBy("tile_id").agg(F.max("col_no").alias("_n"))
    inside = points.filter(F.col("u").between(0.0, 1.0) & F.col("v").between(0.0, 1.0)).join(size, "tile_id")
    pos = inside.withColumn("fx", F.col("u") * F.col("_n")).withColumn("fy", F.col("v") * F.col("_n")).drop("_n")
    got = bilinear(pos, dem.select("tile_id", "row_no", "col_no", S.dem_unpack("packed").alias("elevation")), ["tile_id"], ["elevation"])
    return got.withColumn("elevation", F.col("elevation") * exaggeration).drop("fx", "fy")


def utm_forward(lon, lat, central_meridian, false_easting=500_000.0, false_northing=0.0) -> Column:
    """struct<easting, northing> on the WGS 84 ellipsoid by the published transverse Mercator series; degrees in, metres out."""
    a, f, k0 = 6_378_137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - _c(central_meridian))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    north = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return F.struct((F.lit(false_easting) + k0 * big * east).alias("easting"), (F.lit(false_northing) + k0 * big * north).alias("northing"))


def utm_to_lonlat(px: DataFrame, images: DataFrame) -> DataFrame:
    """Images in a UTM grid as images in degrees of the same size: nearest source pixel, positions rounded half to even; alpha 0 outside and on the last row and column.

    ``images``: tile_id, width, height, bounds (degrees), central_meridian, west_m, north_m, pixel_m.
    """
    grid = images.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    lon = F.col("bounds.west") + (F.col("col_no") + 0.5) / F.col("width") * (F.col("bounds.east") - F.col("bounds.west"))
    lat = F.col("bounds.north") - (F.col("row_no") + 0.5) / F.col("height") * (F.col("bounds.north") - F.col("bounds.south"))
    grid = grid.withColumn("_p", utm_forward(lon, lat, "central_meridian"))
    grid = grid.withColumn("src_col", F.bround((F.col("_p.easting") - F.col("west_m")) / F.col("pixel_m")).cast("int")).withColumn("src_row", F.bround((F.col("north_m") - F.col("_p.northing")) / F.col("pixel_m")).cast("int"))
    source = px.select("tile_id", F.col("row_no").alias("src_row"), F.col("col_no").alias("src_col"), *"rgba")
    met = grid.join(source, ["tile_id", "src_row", "src_col"], "left")
    edge = (F.col("src_row") >= F.col("height") - 1) | (F.col("src_col") >= F.col("width") - 1)
    alpha = F.when(edge | F.col("a").isNull(), 0).otherwise(F.col("a"))
    return met.select("tile_id", "row_no", "col_no", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"], alpha.alias("a"))
