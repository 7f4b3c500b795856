"""Schedule tiling: stop points, trip lines, tiles and their features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial as S

ZOOM, CHUNK_ZOOM, EXTENT, BUFFER = 13, 7, 4096, 64


def stop_points(stops: DataFrame) -> DataFrame:
    """Stops inside the web Mercator square; null coordinates drop out."""
    return stops.filter(F.col("stop_lon").between(-180.0, 180.0) & F.col("stop_lat").between(-S.MAX_LAT, S.MAX_LAT))


def valid_shapes(shapes: DataFrame) -> DataFrame:
    """Shapes whose line has two distinct points."""
    return shapes.filter(F.col("line").isNotNull() & (F.array_min("line") != F.array_max("line")))


def shape_lines(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct (version, route, shape) of trips whose shape is valid."""
    pairs = trips.filter("route_item_id is not null and shape_item_id is not null").select("version_id", "route_item_id", "shape_item_id").distinct()
    return pairs.join(valid_shapes(shapes).select("version_id", "shape_item_id", "line"), ["version_id", "shape_item_id"])


def shape_line_refs(trips: DataFrame, lines: DataFrame) -> DataFrame:
    """(version, trip, route, shape) of trips on a shaped line."""
    own = trips.select("version_id", F.col("item_id").alias("trip_item_id"), "route_item_id", "shape_item_id")
    return own.join(lines.select("version_id", "route_item_id", "shape_item_id"), ["version_id", "route_item_id", "shape_item_id"], "left_semi")


def sequence_candidates(trips: DataFrame, seqs: DataFrame) -> DataFrame:
    """Trips with a route, without a shape and with two stops or more."""
    own = trips.filter("route_item_id is not null and shape_item_id is null").select("version_id", F.col("item_id").alias("trip_item_id"), "route_item_id")
    return own.join(seqs.select("version_id", "trip_item_id", "stop_item_ids"), ["version_id", "trip_item_id"]).filter(F.size("stop_item_ids") >= 2)


def sequence_features(candidates: DataFrame) -> DataFrame:
    """One row for each (version, route, stops): the smallest trip stands for all."""
    return candidates.groupBy("version_id", "route_item_id", "stop_item_ids").agg(F.min("trip_item_id").alias("trip_item_id"))


def sequence_lines(features: DataFrame, points: DataFrame) -> DataFrame:
    """Features with the line through their located stops: two places at least in the sequence, and not all at one position."""
    each = features.select("version_id", "route_item_id", "trip_item_id", F.posexplode("stop_item_ids").alias("at", "stop_item_id"))
    where = points.select("version_id", F.col("item_id").alias("stop_item_id"), "stop_lon", "stop_lat")
    placed = each.join(where, ["version_id", "stop_item_id"])
    line = placed.groupBy("version_id", "route_item_id", "trip_item_id").agg(
        F.array_sort(F.collect_list(F.struct("at", F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")))).alias("_p"),
        F.min("stop_lon").alias("_w"), F.max("stop_lon").alias("_e"), F.min("stop_lat").alias("_s"), F.max("stop_lat").alias("_n"),
    )
    line = line.filter((F.size("_p") >= 2) & ((F.col("_w") != F.col("_e")) | (F.col("_s") != F.col("_n"))))
    return line.select("version_id", "route_item_id", "trip_item_id", F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def sequence_refs(candidates: DataFrame, features: DataFrame, lines: DataFrame) -> DataFrame:
    """(version, trip, line_trip): each candidate and the trip that stands for its line, if the line came about."""
    kept = features.join(lines.select("version_id", "route_item_id", "trip_item_id"), ["version_id", "route_item_id", "trip_item_id"], "left_semi")
    kept = kept.withColumnRenamed("trip_item_id", "line_trip_item_id")
    return candidates.join(kept, ["version_id", "route_item_id", "stop_item_ids"]).select("version_id", "trip_item_id", "line_trip_item_id")


def with_feature_ids(points: DataFrame, shaped: DataFrame | None = None, sequenced: DataFrame | None = None) -> DataFrame:
    """(version_id, kind, k1, k2, feature_id): ids are unique over the three tables and the same in each run. Points come first, so theirs do not depend on the others.

    Numbers are counted in each (version, kind, hash bucket) and shifted by the sizes of those before.
    """
    rows = points.select("version_id", F.lit(0).alias("kind"), F.col("item_id").alias("k1"), F.lit(0).alias("k2"))
    for kind, lines, own in ((1, shaped, "shape_item_id"), (2, sequenced, "trip_item_id")):
        if lines is not None:
            rows = rows.unionByName(lines.select("version_id", F.lit(kind).alias("kind"), F.col("route_item_id").alias("k1"), F.col(own).alias("k2")))
    rows = rows.withColumn("_b", F.floor(F.col("k1") / 4096))
    group = ["version_id", "kind", "_b"]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("version_id").orderBy("kind", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*group).orderBy("k1", "k2")))
    return own.join(sizes.select(*group, before.alias("_before")), group).select("version_id", "kind", "k1", "k2", (F.col("_before") + F.col("_own")).alias("feature_id"))


def add_refs(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A trip's ref that exists already stays."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def tiling_staleness(sources: DataFrame, versions: DataFrame, tilings: DataFrame) -> DataFrame:
    """(source_id, active_version_id, tiled_version_id, outcome)."""
    active = versions.filter("status = 'active'").select(F.col("id").alias("active_version_id"), F.col("source_id").alias("id"))
    latest = tilings.groupBy(F.col("source_id").alias("id")).agg(F.max_by("version_id", F.struct("generated_at", "version_id")).alias("tiled_version_id"))
    state = sources.select("id", "active_version_id").join(active.withColumn("_ok", F.lit(True)), ["id", "active_version_id"], "left").join(latest, "id", "left")
    outcome = F.when(F.col("_ok").isNull(), "no_active").when(F.col("active_version_id") == F.col("tiled_version_id"), "already_current").otherwise("synced")
    return state.select(F.col("id").alias("source_id"), F.when(F.col("_ok"), F.col("active_version_id")).alias("active_version_id"), "tiled_version_id", outcome.alias("outcome"))


def selected_tilings(tilings: DataFrame, sources: DataFrame, slug: str | None = None) -> DataFrame:
    """Tilings of the source with ``slug``, or of all sources."""
    own = sources.select(F.col("id").alias("source_id"), "slug")
    met = tilings.join(own, "source_id")
    return met if slug is None else met.filter(F.col("slug") == slug)


def replace_tiling(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of sources in ``new`` replace all their old rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def extent(points: DataFrame) -> DataFrame:
    """One row: the box of all points inside the Mercator limits."""
    lat = lambda c: S.clamp(c, F.lit(-S.MAX_LAT), F.lit(S.MAX_LAT))
    lon = lambda c: S.clamp(c, F.lit(-180.0), F.lit(180.0))
    return points.agg(lon(F.min("stop_lon")).alias("west"), lat(F.min("stop_lat")).alias("south"), lon(F.max("stop_lon")).alias("east"), lat(F.max("stop_lat")).alias("north"))


def tiling_summary(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: sources tried, and those whose tiling (source_id, error) ended well, failed, or was not tried."""
    own = sources.select(F.col("id").alias("source_id")).join(attempts.groupBy("source_id").agg(F.max(F.col("error").isNotNull()).alias("_bad")), "source_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return own.agg(n(F.col("_bad").isNotNull()).alias("tried"), n(~F.col("_bad")).alias("succeeded"), n(F.col("_bad")).alias("failed"), n(F.col("_bad").isNull()).alias("skipped"))


def occupied_tiles(points: DataFrame, zoom: int) -> DataFrame:
    """Tiles with a stop in them or on their edge. No candidate is listed: each point names its tiles."""
    return tile_points(points, zoom).select("z", "x", "y").distinct()


def own_tiles(points: DataFrame, zoom: int) -> DataFrame:
    """The one tile of each point: a point on an edge is in the tile to the right of it and below it."""
    return points.select(F.lit(zoom).alias("z"), S.lon_to_tile_x("stop_lon", zoom).alias("x"), S.lat_to_tile_y("stop_lat", zoom).alias("y")).distinct()


def child_tiles(tiles: DataFrame, zoom: int) -> DataFrame:
    """All tiles of ``zoom`` below tiles (z, x, y)."""
    d = F.lit(zoom) - F.col("z")
    span = lambda c: F.sequence(F.expr(f"shiftleft({c}, {zoom} - z)"), F.expr(f"shiftleft({c} + 1, {zoom} - z) - 1"))
    out = tiles.filter(d >= 0).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    return out.select(F.col("z").alias("parent_z"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.lit(zoom).alias("z"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def tile_position(lon, lat, z: int, x, y, size: int = EXTENT) -> tuple[Column, Column]:
    """Integer position in a tile, y down."""
    n = 2.0**z
    fx = (F.col(lon) + 180.0) / 360.0 * n - F.col(x)
    r = F.radians(F.col(lat))
    fy = (1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n - F.col(y)
    return F.floor(fx * size + 0.5).cast("int"), F.floor(fy * size + 0.5).cast("int")


def tile_points(points: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """Points with the tiles (z, x, y) they are in and their position there; a point on an edge is in the tiles on both sides."""
    p = points.withColumn("_x", S.lon_to_tile_x("stop_lon", zoom)).withColumn("_y", S.lat_to_tile_y("stop_lat", zoom))
    near = lambda c: F.array(F.col(c) - 1, F.col(c))
    p = p.withColumn("z", F.lit(zoom)).withColumn("x", F.explode(near("_x"))).withColumn("y", F.explode(near("_y"))).drop("_x", "_y")
    n = float(2**zoom)
    p = p.filter((F.col("x") >= 0) & (F.col("y") >= 0))
    # Only a western or northern edge can be another tile's: floor takes the tile to the right of it and below it.
    east = (F.col("x") + 1) / n * 360.0 - 180.0
    p = p.filter(((F.col("x") == S.lon_to_tile_x("stop_lon", zoom)) | (F.col("stop_lon") == east)) & ((F.col("y") == S.lat_to_tile_y("stop_lat", zoom)) | (F.col("stop_lat") == S.tile_y_to_lat(F.col("y") + 1, zoom))))
    px, py = tile_position("stop_lon", "stop_lat", zoom, "x", "y")
    return p.withColumn("px", px).withColumn("py", py)


def route_summary(agg: DataFrame, routes: DataFrame) -> DataFrame:
    """(version, stop, route_types sorted as text and joined by commas, route_count): a route without a row counts but has no type."""
    each = agg.select("version_id", "stop_item_id", F.size("route_item_ids").alias("route_count"), F.explode_outer("route_item_ids").alias("route_item_id"))
    kind = routes.select("version_id", F.col("item_id").alias("route_item_id"), "route_type")
    met = each.join(kind, ["version_id", "route_item_id"], "left")
    return met.groupBy("version_id", "stop_item_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("route_type").cast("string"))), ",").alias("route_types"), F.max("route_count").alias("route_count"))


#: What a stop carries in a tile, besides its tile and place.
ATTRIBUTES = ("feature_id", "source_slug", "stop_item_id", "stop_id", "stop_code", "stop_name", "stop_desc", "parent_station_id", "location_type", "wheelchair_boarding", "platform_code", "route_types", "route_count")


def tile_features(points: DataFrame, agg: DataFrame, routes: DataFrame, stops: DataFrame, tilings: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """A row for each tile and stop with all attributes; absent texts are empty, absent numbers 0.

    ``tilings`` (version_id, slug) are those that are exported: stops of other versions are left out.
    """
    parents = stops.select("version_id", F.col("item_id").alias("parent_station_item_id"), F.col("item_gtfs_id").alias("_parent"))
    numbers = with_feature_ids(points).select("version_id", F.col("k1").alias("stop_item_id"), "feature_id")
    rows = tile_points(points, zoom).withColumnRenamed("item_id", "stop_item_id").join(tilings.select("version_id", F.col("slug").alias("source_slug")), "version_id")
    rows = rows.join(numbers, ["version_id", "stop_item_id"]).join(route_summary(agg, routes), ["version_id", "stop_item_id"], "left").join(parents, ["version_id", "parent_station_item_id"], "left")
    text = {"stop_code": "stop_code", "stop_name": "stop_name", "stop_desc": "stop_desc", "parent_station_id": "_parent", "platform_code": "platform_code", "route_types": "route_types"}
    number = ("location_type", "wheelchair_boarding", "route_count")
    rows = rows.withColumn("stop_id", F.col("item_gtfs_id")).withColumns({c: F.coalesce(own, F.lit("")) for c, own in text.items()} | {c: F.coalesce(c, F.lit(0)) for c in number})
    return rows.select("version_id", "z", "x", "y", *ATTRIBUTES, "px", "py")


def tiles(features: DataFrame) -> DataFrame:
    """One row a tile: its features as JSON, by feature id."""
    own = F.struct(*ATTRIBUTES, "px", "py")
    return features.groupBy("version_id", "z", "x", "y").agg(F.count(F.lit(1)).alias("n_features"), F.to_json(F.array_sort(F.collect_list(own))).alias("payload"))


def export_totals(tiles_: DataFrame, zoom: int = CHUNK_ZOOM) -> DataFrame:
    """Chunks of the export with the number of their tiles and their place (from 1) of all chunks of the zoom."""
    shift = lambda c: F.expr(f"shiftright({c}, z - {zoom})")
    cut = tiles_.withColumn("chunk_x", shift("x")).withColumn("chunk_y", shift("y"))
    return cut.groupBy("chunk_x", "chunk_y").agg(F.count(F.lit(1)).alias("n_tiles")).withColumn("progress", F.col("chunk_y").cast("long") * 2**zoom + F.col("chunk_x") + 1).withColumn("of", F.lit(4**zoom).cast("long"))


# Route types that a stop's summary may name alone.
SPECIFIC = ("0", "1", "2", "3", "4", "5", "6", "7", "11", "12", "200", "1100", "1500")


def is_root_stop() -> Column:
    return (F.col("parent_station_id") == "") & F.col("location_type").isin(0, 1) & F.col("route_types").isin(*SPECIFIC)


def stop_symbol() -> Column:
    t = F.col("location_type")
    return (
        F.when(t == 1, "station").when(t == 2, "entrance_exit").when(t == 3, "generic_node").when(t == 4, "boarding_area")
        .when(F.coalesce("platform_code", F.lit("")) != "", "platform").when(F.coalesce("stop_code", F.lit("")) != "", "stop").otherwise("unknown")
    )
