"""Schedule queries over whole tables or a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import new_path, save

# The category (an icon name) of each route type.
CATEGORIES = {
    0: "tram-front", 1: "train-front", 2: "train-front", 3: "bus-front", 4: "ship", 5: "cable-car", 6: "cable-car", 7: "mountain",
    11: "bus-front", 12: "train-front", 200: "bus-front", 1100: "plane", 1500: "car-taxi-front",
}
GENERIC = "route"
#: Levels of a nested tree that one plan builds.
STRIDE = 8


def stop_tree(stops: DataFrame, agg: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Every stop with all its descendants: version_id, root_id, stop_id, parent_id, depth, path, route_item_ids.

    A self-join a level until no path grows, however deep; a stop that is on its own path already is not entered again. Each
    level is written, so the next one reads it and runs none of those before again.
    ``roots`` (version_id, item_id): where to begin; all stops if not given.
    """
    own = stops.select("version_id", F.col("item_id").alias("stop_id"), F.col("parent_station_item_id").alias("parent_id"))
    start = own if roots is None else own.join(roots.select("version_id", F.col("item_id").alias("stop_id")).distinct(), ["version_id", "stop_id"], "left_semi")
    level = start.select("version_id", F.col("stop_id").alias("root_id"), "stop_id", "parent_id", F.lit(0).alias("depth"), F.array("stop_id").alias("path"))
    spark, path, depth = stops.sparkSession, new_path(stops.sparkSession), 0
    at = lambda d: f"{path}/depth-{d}"
    level.write.parquet(at(0))
    child = own.filter("parent_id is not null")
    while True:
        depth += 1
        level = spark.read.schema(level.schema).parquet(at(depth - 1))
        up = level.select("version_id", "root_id", F.col("stop_id").alias("parent_id"), "path")
        level = up.join(child, ["version_id", "parent_id"]).filter(~F.array_contains("path", F.col("stop_id")))
        level = level.select("version_id", "root_id", "stop_id", "parent_id", F.lit(depth).alias("depth"), F.concat("path", F.array("stop_id")).alias("path"))
        level.write.parquet(at(depth))
        if spark.read.schema(level.schema).parquet(at(depth)).isEmpty():
            break
    found = spark.read.schema(level.schema).parquet(*map(at, range(depth)))
    routes = agg.select("version_id", F.col("stop_item_id").alias("stop_id"), "route_item_ids")
    return found.join(routes, ["version_id", "stop_id"], "left").withColumn("route_item_ids", F.coalesce("route_item_ids", F.array().cast("array<int>")))


def nest_stops(tree: DataFrame) -> DataFrame:
    """One JSON text a root: children inside their parents, built from the deepest level up; every ``STRIDE`` levels are written, so plans stay short."""
    rows = save(tree.select("version_id", "root_id", "stop_id", "parent_id", "depth", "route_item_ids"), "depth")
    deepest = rows.agg(F.max("depth")).first()[0]
    node = lambda: F.concat(
        F.lit('{"stop":'), F.col("stop_id").cast("string"), F.lit(',"routes":'), F.to_json("route_item_ids"), F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")
    )
    kids = None
    for depth in range(deepest or 0, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        level = level.withColumn("kids", F.lit(None).cast("string")) if kids is None else level.join(kids, ["version_id", "root_id", "stop_id"], "left")
        level = level.withColumn("json", node())
        if depth == 0:
            return level.select("version_id", "root_id", "json")
        kids = level if depth % STRIDE else save(level)
        kids = kids.groupBy("version_id", "root_id", F.col("parent_id").alias("stop_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("stop_id").alias("s"), "json"))), lambda x: x["json"]), ",").alias("kids"))
    return rows.select("version_id", "root_id", F.lit("").alias("json")).limit(0)


def flatten_tree(tree: DataFrame) -> DataFrame:
    """Breadth-first place of each stop below its root."""
    return tree.withColumn("place", F.row_number().over(Window.partitionBy("version_id", "root_id").orderBy("depth", "stop_id")))


def tree_route_ids(tree: DataFrame) -> DataFrame:
    """Sorted distinct routes of a whole stop tree."""
    each = tree.select("version_id", "root_id", F.explode("route_item_ids").alias("r"))
    some = each.groupBy("version_id", "root_id").agg(F.array_sort(F.collect_set("r")).alias("route_item_ids"))
    return tree.select("version_id", "root_id").distinct().join(some, ["version_id", "root_id"], "left").withColumn("route_item_ids", F.coalesce("route_item_ids", F.array().cast("array<int>")))


def stop_trip_lines(agg: DataFrame, lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Lines of the routes at each stop: version_id, stop_item_id, feature_id, route_item_id, color with ``#``."""
    each = agg.select("version_id", "stop_item_id", F.explode("route_item_ids").alias("route_item_id"))
    color = routes.select("version_id", F.col("item_id").alias("route_item_id"), F.concat(F.lit("#"), "route_color").alias("color"))
    return each.join(lines.select("version_id", "route_item_id", "feature_id"), ["version_id", "route_item_id"]).join(color, ["version_id", "route_item_id"])


def route_details(routes: DataFrame, agency: DataFrame) -> DataFrame:
    """Routes with their agency's columns; a route without an agency keeps nulls."""
    return routes.join(agency, ["version_id", "agency_item_id"], "left")


def osm_lookup(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (kind node, way or relation; osm_key) with attributes and whether the element was found."""
    kind = F.when(F.col("kind") == "node", "N").when(F.col("kind") == "way", "W").when(F.col("kind") == "relation", "R")
    there = elements.select("osm_type", "osm_key", "tags", F.lit(True).alias("_there"))
    return requests.withColumn("osm_type", kind).join(there, ["osm_type", "osm_key"], "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def category(route_type) -> Column:
    c = route_type if isinstance(route_type, Column) else F.col(route_type)
    return F.element_at(F.create_map(*[F.lit(v) for pair in CATEGORIES.items() for v in pair]), c.cast("int"))


def station_category(df: DataFrame, keys: list[str], route_types: str) -> DataFrame:
    """The category that the known ones of a list of route types (``0,3``) have in common; else the generic one."""
    each = df.select(*keys, F.explode_outer(F.split(F.col(route_types), ",")).alias("_t"))
    kind = category(F.trim("_t").try_cast("int"))
    return each.groupBy(*keys).agg(F.when(F.count_distinct(kind) == 1, F.min(kind)).otherwise(GENERIC).alias("category"))


def stop_title(name, platform, code, item) -> Column:
    """First of these texts that is not empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (name, platform, code, item)])


def route_title(short, long, item) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" - ", *[F.nullif(F.col(c), F.lit("")) for c in (short, long)]), F.lit("")), F.col(item))


def record_rows(df: DataFrame, keys: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """A record as (key, value) rows: null as an empty text, nested values as JSON."""
    columns = [f for f in df.schema.fields if f.name not in (*keys, *exclude)]
    text = [(F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name).cast("string")).alias(f.name) for f in columns]
    rows = df.select(*keys, *text).unpivot(keys, [f.name for f in columns], "key", "value")
    return rows.withColumn("value", F.coalesce("value", F.lit("")))
