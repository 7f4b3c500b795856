"""Measures of features by tile: edge distance, masks, nearest directions, components."""

from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spatial as S
from ..steps import save


def layer_summary(features: DataFrame) -> DataFrame:
    """Extent and number of features of each layer."""
    return features.groupBy("layer").agg(F.max("extent").alias("extent"), F.count(F.lit(1)).alias("n_features"))


def segments(lines: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Directed segments of lines (array of struct x, y); rings are closed with ``closed``; segments without length drop out. Adds the unit direction."""
    pts = F.concat("line", F.slice("line", 1, 1)) if closed else F.col("line")
    each = lines.select(*keys, F.posexplode(F.arrays_zip(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))).alias("a"), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))).alias("b"))).alias("seg", "p"))
    out = each.select(*keys, "seg", F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"))
    n = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return out.filter(n > 0).withColumn("dx", (F.col("bx") - F.col("ax")) / n).withColumn("dy", (F.col("by") - F.col("ay")) / n)


def edge_distance(edges: DataFrame, w: int, h: int, most: float, bins: int = 64) -> DataFrame:
    """(tile_id, row_no, col_no, value): distance of each cell's centre (unit square) to the nearest edge of its tile, capped at ``most`` and divided by it; a tile in ``edges`` without any (null ends) is 0 all over.

    Edges go to the bins of a grid that their box, grown by ``most``, touches; cells meet the edges of their own bin.
    """
    bins = max(1, min(bins, int(1 / most) if most else 1))
    tiles = edges.groupBy("tile_id").agg(F.count("ax").alias("_edges"))
    span = lambda lo, hi: F.sequence(
        F.greatest(F.floor((lo - most) * bins), F.lit(0)).cast("int"), F.least(F.floor((hi + most) * bins), F.lit(bins - 1)).cast("int"))
    x0, x1, y0, y1 = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    near = edges.filter((x1 >= -most) & (x0 <= 1 + most) & (y1 >= -most) & (y0 <= 1 + most))
    near = near.withColumn("_bx", F.explode(span(x0, x1))).withColumn("_by", F.explode(span(y0, y1)))
    cells = tiles.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    cx, cy = (F.col("col_no") + 0.5) / w, (F.col("row_no") + 0.5) / h
    cells = cells.withColumn("_bx", F.floor(cx * bins).cast("int")).withColumn("_by", F.floor(cy * bins).cast("int"))
    met = cells.join(near.select("tile_id", "_bx", "_by", "ax", "ay", "bx", "by"), ["tile_id", "_bx", "_by"])
    least = met.groupBy("tile_id", "row_no", "col_no").agg(F.min(S.seg_dist_sq(cx, cy, "ax", "ay", "bx", "by")).alias("_d"))
    out = cells.join(least, ["tile_id", "row_no", "col_no"], "left")
    value = F.when(F.col("_edges") == 0, 0.0).otherwise(F.coalesce(F.least(F.sqrt("_d"), F.lit(float(most))) / most, F.lit(1.0)))
    return out.select("tile_id", "row_no", "col_no", value.alias("value"))


#: Points of one place, or polygons of one shape, that are moved together.
PACK = 512


def _shapes(edges: DataFrame, polygon: str) -> tuple[DataFrame, DataFrame]:
    """Edges of one polygon of each shape (_shape, ax, ay, bx, by), and the polygons of each shape in packs (_shape, _part, _polygons).

    Polygons have one shape when their edges are the same, told by their number and two sums of 64-bit hashes.
    """
    ends = ("ax", "ay", "bx", "by")
    e = edges.select(polygon, *ends).filter(F.col(polygon).isNotNull())
    total = lambda k: F.sum(F.xxhash64(F.lit(k), *ends, *[F.col(c).isNull() for c in ends]).cast("decimal(20,0)")).alias(f"_h{k}")
    sign = ["_n", "_h0", "_h1"]
    signed = e.groupBy(polygon).agg(F.count(F.lit(1)).alias("_n"), total(0), total(1))
    shapes = signed.groupBy(*sign).agg(F.min(polygon).alias("_shape"), F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
    dealt = signed.join(shapes, sign).withColumn("_part", F.pmod(F.xxhash64(polygon), "_packs"))
    members = dealt.groupBy("_shape", "_part").agg(F.collect_list(polygon).alias("_polygons"))
    return e.withColumnRenamed(polygon, "_shape").join(shapes.select("_shape"), "_shape", "left_semi"), members


def _held(places: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(x, y, _shape) of distinct places inside shapes given as ring edges (_shape, ax, ay, bx, by), holes included: an odd number of edges to the right.

    Places meet the shapes whose box touches their cell of a grid, and each shape brings the edges that pass the cell's row and
    end to the right of its left side: one join by equality, after which no pair is moved.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    box = edges.groupBy("_shape").agg(*[f(g(a, b)).alias(n) for n, f, g, a, b in (("_w", F.min, F.least, "ax", "bx"), ("_e", F.max, F.greatest, "ax", "bx"), ("_s", F.min, F.least, "ay", "by"), ("_n", F.max, F.greatest, "ay", "by"))])
    rows = edges.withColumn("_row", F.explode(F.sequence(at(F.least("ay", "by")), at(F.greatest("ay", "by"))))).withColumn("_last", at(F.greatest("ax", "bx")))
    each = rows.join(box, "_shape").withColumn("_col", F.explode(F.sequence(at(F.col("_w")), F.col("_last"))))
    cells = each.groupBy("_shape", "_col", "_row").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("_edges"), *[F.first(c).alias(c) for c in ("_w", "_e", "_s", "_n")])
    own = places.select("x", "y", at(F.col("x")).alias("_col"), at(F.col("y")).alias("_row"))
    # A place may meet many shapes: few rows are much work, so both sides are dealt out whatever their size.
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, cells = own.repartition(n, "x", "y"), cells.repartition(n, "_shape", "_col", "_row")
    near = own.join(cells, ["_col", "_row"]).filter(F.col("x").between(F.col("_w"), F.col("_e")) & F.col("y").between(F.col("_s"), F.col("_n")))
    crossed = F.size(F.filter("_edges", lambda q: S.ring_crosses("x", "y", q["ax"], q["ay"], q["bx"], q["by"])))
    return near.filter(crossed % 2 == 1).select("x", "y", "_shape")


def _packed(rows: DataFrame, place: list[str], keys: list[str]) -> DataFrame:
    """Packs of ``PACK`` of the distinct ``rows`` (place, keys) of a place: (place, _pack, _slice, _keys: an array of structs). Dealt by hash first, so that a place with many rows is many tasks."""
    sizes = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / (16 * PACK)).alias("_packs"))
    dealt = rows.join(sizes, place).withColumn("_pack", F.pmod(F.xxhash64(*keys), "_packs"))
    packs = dealt.groupBy(*place, "_pack").agg(F.collect_list(F.struct(*keys)).alias("_all"))
    # Cut to one size: keys in a pack of a multiple of eight are written as the same bytes each time that they come.
    cut = packs.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / PACK).cast("int"))))
    return cut.select(*place, "_pack", "_slice", F.slice("_all", F.col("_slice") * PACK + 1, F.lit(PACK)).alias("_keys"))


def _spread(packs: DataFrame, members: DataFrame, polygon: str, by: list[str]) -> DataFrame:
    """(keys, polygon) of packs (_shape, _keys: an array of structs, and the columns ``by`` that tell them apart), each with every polygon of its shape.

    A pair of packs is few bytes and many rows, so these are dealt out whatever their size. Rows of a pair come polygon by polygon, the keys always in the same
    order: what is written of them packs to a small part of what it takes in any other order.
    """
    n = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = packs.join(members, "_shape").repartition(n, *by, "_part")
    return pairs.select("_keys", F.explode("_polygons").alias(polygon)).select(F.explode("_keys").alias("_k"), polygon).select("_k.*", polygon)


def in_polygon(points: DataFrame, edges: DataFrame, point_keys: list[str], polygon: str, cell: float) -> DataFrame:
    """(point keys, polygon) of points inside polygons given as ring edges (polygon, ax, ay, bx, by), holes included.

    Points of one place and polygons of one shape are tested once (``_held``), and then meet by packs of ``PACK``.
    """
    shapes, members = _shapes(edges, polygon)
    # Rows that are the same in all are told apart by a number, so that a pack holds no more of them than of others.
    same = points.filter("x is not null and y is not null").groupBy(*point_keys, "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    packs = _packed(same, ["x", "y", "_n"], point_keys).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    held = _held(same.select("x", "y").distinct(), shapes, cell)
    return _spread(packs.join(held, ["x", "y"]), members, polygon, ["x", "y", "_n", "_pack", "_slice", "_copy"])


def raster_mask(edges: DataFrame, polygon: str, n: int) -> DataFrame:
    """Cells of an n by n grid over the unit square in each polygon, marked ``boundary`` where a 4-neighbour is outside or beyond the frame."""
    spark = edges.sparkSession
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row_no"), (F.col("id") % n).cast("int").alias("col_no"))
    cells = cells.withColumn("x", (F.col("col_no") + 0.5) / n).withColumn("y", (F.col("row_no") + 0.5) / n)
    inside = in_polygon(cells, edges, ["row_no", "col_no"], polygon, 1.0 / n)
    across, down = Window.partitionBy(polygon, "row_no").orderBy("col_no"), Window.partitionBy(polygon, "col_no").orderBy("row_no")
    whole = (F.coalesce(F.lead("col_no").over(across) == F.col("col_no") + 1, F.lit(False)) & F.coalesce(F.lag("col_no").over(across) == F.col("col_no") - 1, F.lit(False))
             & F.coalesce(F.lead("row_no").over(down) == F.col("row_no") + 1, F.lit(False)) & F.coalesce(F.lag("row_no").over(down) == F.col("row_no") - 1, F.lit(False)))
    return inside.withColumn("boundary", ~whole)


def component_segments(segs: DataFrame, edges: DataFrame, polygon: str, cell: float) -> DataFrame:
    """(segment_id, polygon): polygons that hold an end or the middle of a segment.

    Each polygon has one shape, so segments are made distinct by shape, before they meet its polygons: the pairs themselves are not moved.
    """
    shapes, members = _shapes(edges, polygon)
    ends = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), ((F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2))])
    pts = segs.select("segment_id", F.inline(ends)).filter("x is not null and y is not null")
    found = pts.join(_held(pts.select("x", "y").distinct(), shapes, cell), ["x", "y"]).select("segment_id", "_shape").distinct()
    return _spread(_packed(found, ["_shape"], ["segment_id"]), members, polygon, ["_shape", "_pack", "_slice"])


def segments_inside(segs: DataFrame, edges: DataFrame, polygon: str, cell: float) -> DataFrame:
    """(segment_id, polygon) where both ends are inside."""
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    pts = segs.select("segment_id", F.posexplode(ends).alias("at", "p")).select("segment_id", "at", "p.x", "p.y")
    hit = in_polygon(pts, edges, ["segment_id", "at"], polygon, cell)
    return hit.groupBy("segment_id", polygon).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 2").drop("_n")


def components(edges: DataFrame, nodes: DataFrame, keys: list[str], save) -> DataFrame:
    """``nodes`` (keys, node) with ``label``: the smallest node that links of ``edges`` (keys, a, b) lead to.

    In a round each node goes to the neighbour (or itself) whose hash of node and round is smallest, and links between what they have become stay. About
    half of the nodes of a path are left after each, so rounds grow with the logarithm of the nodes, whatever their order.
    Each step is an aggregate or an equality join. ``save`` writes a step and reads it back.
    """
    links = save(edges.filter("a != b").select(*keys, "a", "b").distinct())
    steps, round_no = [], 0
    while not links.isEmpty():
        both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(round_no)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        to = both.groupBy(*keys, "a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("t"))
        step = save(to.select(*keys, "a", F.col("t.node").alias("to")))
        steps.append(step)
        renamed = links.join(step.withColumnRenamed("to", "_a"), [*keys, "a"]).join(step.select(*keys, F.col("a").alias("b"), F.col("to").alias("_b")), [*keys, "b"])
        pair = renamed.filter("_a != _b").select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        links = save(pair.distinct())
        round_no += 1
    # From the last round back: what a node has become is what its successor has become.
    end = None
    for step in reversed(steps):
        if end is None:
            end = step.select(*keys, "a", F.col("to").alias("end"))
        else:
            # A node of this round that is in no later one is its own end.
            own = step.join(end.select(*keys, F.col("a").alias("to"), F.col("end").alias("_end")), [*keys, "to"], "left")
            end = own.select(*keys, "a", F.coalesce("_end", "to").alias("end"))
        end = save(end)
    if end is None:
        return nodes.withColumn("label", F.col("node"))
    named = save(nodes.join(end.withColumnRenamed("a", "node"), [*keys, "node"], "left").withColumn("end", F.coalesce("end", "node")))
    least = named.groupBy(*keys, "end").agg(F.min("node").alias("label"))
    return named.join(least, [*keys, "end"]).drop("end")


def grid_components(mask: DataFrame, keys: list[str], save) -> DataFrame:
    """Cells (keys, row_no, col_no) with the smallest cell number of their 4-connected component. Runs of cells in a row are the nodes, runs that touch in neighbouring
    rows the links of ``components``. ``save``: writes a step and reads it back, so lineage stays short."""
    n = (mask.agg(F.max("col_no")).first()[0] or 0) + 1
    line = Window.partitionBy(*keys, "row_no").orderBy("col_no")
    start = F.when(F.coalesce(F.lag("col_no").over(line) == F.col("col_no") - 1, F.lit(False)), F.lit(None)).otherwise(F.col("col_no"))
    runs = mask.select(*keys, "row_no", "col_no").withColumn("_start", F.last(start, ignorenulls=True).over(line))
    cells = save(runs.select(*keys, "row_no", "col_no", (F.col("row_no").cast("long") * n + F.col("_start")).alias("node")))
    below = cells.select(*keys, (F.col("row_no") - 1).alias("row_no"), "col_no", F.col("node").alias("b"))
    links = cells.withColumnRenamed("node", "a").join(below, [*keys, "row_no", "col_no"]).select(*keys, "a", "b")
    labels = components(links, cells.select(*keys, "node").distinct(), keys, save)
    return cells.join(labels, [*keys, "node"]).select(*keys, "row_no", "col_no", "label")


def center_by_component(df: DataFrame, component: list[str], value: str) -> DataFrame:
    return df.withColumn("centered", F.col(value) - F.avg(value).over(Window.partitionBy(*component)))


def _nearest(points: DataFrame, segs: DataFrame, group: list[str], k: int, cell: float | None = None) -> DataFrame:
    """Each point (group, point_id, x, y) with its k nearest segments of the same group (all, if there are fewer), and ``_d``, the squared distance; ties by segment_id.

    Segments go to the cells of a grid that their box, grown by a radius, touches, and points meet those of their own cell. A
    point is done when k of them are within the radius, as no other can be nearer, or when it has met all segments of its group; the others go on with twice the
    radius and cell. Each group begins with a radius by its own density, at which most points have k segments (or with ``cell``). Points and segments without a
    finite place are left out.
    """
    finite = lambda d, *cs: d.filter(" and ".join(f"{c} between -1e300 and 1e300" for c in cs))
    points, segs = finite(points, "x", "y"), finite(segs, "ax", "ay", "bx", "by")
    box = segs.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"), *[(F.max(F.greatest(a, b)) - F.min(F.least(a, b))).alias(n) for n, a, b in (("_w", "ax", "bx"), ("_h", "ay", "by"))])
    own = F.greatest(1.2 * F.sqrt(F.col("_w") * F.col("_h") * k / F.col("_all")), (F.col("_w") + F.col("_h")) * 1e-3)
    first = save(box.select(*group, "_all", (F.lit(float(cell)) if cell else F.when(own > 0, own).otherwise(1.0)).alias("_r")))
    left, segs = points.join(first, group), segs.join(first.select(*group, "_r"), group)
    at = lambda c: F.floor(c / F.col("_r")).cast("long")
    span = lambda a, b: F.sequence(at(F.least(a, b) - F.col("_r")), at(F.greatest(a, b) + F.col("_r")))
    mine = Window.partitionBy(*group, "point_id")
    found = None
    while True:
        placed = segs.withColumn("_cx", F.explode(span("ax", "bx"))).withColumn("_cy", F.explode(span("ay", "by"))).drop("_r")
        met = left.withColumn("_cx", at(F.col("x"))).withColumn("_cy", at(F.col("y"))).join(placed, [*group, "_cx", "_cy"]).drop("_cx", "_cy")
        met = met.withColumn("_d", S.seg_dist_sq("x", "y", "ax", "ay", "bx", "by"))
        near = met.withColumn("_n", F.row_number().over(mine.orderBy("_d", "segment_id"))).filter(F.col("_n") <= k)
        # Rounding may not decide that a point is done.
        done = near.withColumn("_far", F.max("_d").over(mine)).withColumn("_k", F.count(F.lit(1)).over(mine))
        done = done.filter(((F.col("_k") == k) & (F.col("_far") < F.col("_r") * F.col("_r") * (1 - 1e-9))) | (F.col("_k") == F.col("_all")))
        near = save(done.drop("_far", "_k", "_n", "_r", "_all"))
        found = near if found is None else found.unionByName(near)
        left = save(left.join(near.select(*group, "point_id").distinct(), [*group, "point_id"], "left_anti").withColumn("_r", F.col("_r") * 2))
        if left.isEmpty():
            return found
        segs = segs.join(left.select(*group).distinct(), group, "left_semi").withColumn("_r", F.col("_r") * 2)


def knn_direction(points: DataFrame, segs: DataFrame, group: list[str], sigma: float, k: int, cell: float | None = None) -> DataFrame:
    """Per point the weighted mean direction of its k nearest segments in the same group: weight exp(-d2 / sigma2) * confidence; null where weight or length is 1e-9 or less."""
    near = _nearest(points, segs, group, k, cell)
    w = F.exp(-F.col("_d") / sigma**2) * F.col("confidence")
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    sums = near.groupBy(*group, "point_id").agg(F.sum(w).alias("weight"), F.sum(w * (F.col("bx") - F.col("ax")) / length).alias("_x"), F.sum(w * (F.col("by") - F.col("ay")) / length).alias("_y"))
    size = F.hypot("_x", "_y")
    ok = (F.col("weight") > 1e-9) & (size > 1e-9)
    return sums.select(*group, "point_id", F.when(ok, F.col("_x") / size).alias("dx"), F.when(ok, F.col("_y") / size).alias("dy"), F.when(ok, size / F.col("weight")).alias("magnitude"), "weight")


def nearest_normal(points: DataFrame, boundary: DataFrame, group: list[str], cell: float | None = None) -> DataFrame:
    """Normal (left of the direction) of the boundary segment nearest to each point."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    near = _nearest(points, boundary.filter(length > 0), group, 1, cell)
    return near.select(*group, "point_id", (-(F.col("by") - F.col("ay")) / length).alias("nx"), ((F.col("bx") - F.col("ax")) / length).alias("ny"), F.sqrt("_d").alias("distance"))


def project_tangent(vx, vy, nx, ny) -> Column:
    """struct<x, y>: a vector without its part along a unit normal."""
    vx, vy, nx, ny = (F.col(c) if isinstance(c, str) else c for c in (vx, vy, nx, ny))
    along = vx * nx + vy * ny
    return F.struct((vx - along * nx).alias("x"), (vy - along * ny).alias("y"))


def finite_abs_mean(df: DataFrame, value: str) -> DataFrame:
    """One row: mean absolute value of the finite values, 0 without any."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    return df.agg(F.coalesce(F.avg(F.when(finite, F.abs(v))), F.lit(0.0)).alias("mean"))


def class_filter(features: DataFrame, prop: str, values: tuple[str, ...]) -> DataFrame:
    return features.filter(F.col("properties")[prop].isin(*values))


def building_heights(features: DataFrame, top_keys: tuple[str, ...], base_keys: tuple[str, ...], least: float = 0.1) -> DataFrame:
    """Base (default 0) and top of buildings from the first property that reads as a number; the top is ``least`` above the base at least. Without a top there is no building."""
    num = lambda keys: F.coalesce(*[F.col("properties")[k].try_cast("double") for k in keys])
    out = features.withColumn("base", F.coalesce(num(base_keys), F.lit(0.0))).withColumn("_top", num(top_keys)).filter("_top is not null")
    return out.withColumn("top", F.greatest("_top", F.col("base") + least)).drop("_top")


def repair_feature_ids(features: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``new_id`` decimal(20,0): in order of ``place``, a feature keeps an id that none before it in its group (``keys``, a tile and layer) has; others, and
    those without one, get 2^63 + place, raised by one until it is free.

    Only given ids of 2^63 or more can be in the way; groups that have one are worked through in order, the rest is column arithmetic.
    """
    order = Window.partitionBy(*keys, "id").orderBy("place")
    high = (F.lit(1 << 62).cast("decimal(20,0)") * 2 + F.col("place")).cast("decimal(20,0)")

    def apart(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("_first", F.col("id").isNotNull() & (F.row_number().over(order) == 1))
        return own.withColumn("new_id", F.when(F.col("_first"), F.col("id").cast("decimal(20,0)")).otherwise(high)).drop("_first")

    if not isinstance(features.schema["id"].dataType, T.DecimalType):
        # A signed 64-bit id is below 2^63.
        return apart(features)
    tall = features.filter(F.col("id") >= F.lit(Decimal(1 << 63))).select(*keys).distinct()
    schema = T.StructType([*features.schema.fields, T.StructField("new_id", T.DecimalType(20, 0))])

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        taken, out = set(), []
        for own, place in zip(group["id"], group["place"]):
            new = None if own is None or own in taken else int(own)
            if new is None:
                new = (1 << 63) + int(place)
                while new in taken:
                    new += 1
            taken.add(new)
            out.append(Decimal(new))
        return group.assign(new_id=out)

    worked = features.join(tall, keys, "left_semi").groupBy(*keys).applyInPandas(in_order, schema)
    return apart(features.join(tall, keys, "left_anti")).unionByName(worked)


def select_layer(layers: DataFrame, name: str, extent: int = 4096) -> DataFrame:
    """The rows of one layer; an extent that is missing or not positive is ``extent``."""
    return layers.filter(F.col("layer") == name).withColumn("extent", F.when(F.col("extent") > 0, F.col("extent")).otherwise(extent))


def explode_parts(features: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of multi-geometries as rows; ``parts`` is an array of lines."""
    return features.select(*keys, F.posexplode("parts").alias("part", "line"))
