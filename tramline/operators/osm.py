"""Attributes of map elements: tag maps in, readable columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that say nothing about the element.
DROPPED = ("odbl", "created_by", "source", "source:ref")


def clean_tags(df: DataFrame) -> DataFrame:
    """Elements without such tags; those left with none drop out."""
    out = df.withColumn("tags", F.map_filter("tags", lambda k, _: ~k.isin(*DROPPED)))
    return out.filter(F.size("tags") > 0)


def geom_kind(osm_type) -> Column:
    c = F.col(osm_type) if isinstance(osm_type, str) else osm_type
    return F.when(c == "N", "point").when(c == "W", "line").when(c == "R", "collection")


def first_tag(tags, *keys: str) -> Column:
    """First value of these keys that is more than white space, trimmed."""
    m = F.col(tags) if isinstance(tags, str) else tags
    return F.coalesce(*[F.nullif(F.trim(m[k]), F.lit("")) for k in keys])


def merged(tags, properties) -> Column:
    """Feature properties with the element's tags over them."""
    p, t = (F.col(c) if isinstance(c, str) else c for c in (properties, tags))
    return F.map_concat(F.map_filter(p, lambda k, _: ~F.map_contains_key(t, k)), t)


def address(tags) -> Column:
    """``street nr, postcode city, country`` without what is absent; a full address wins."""
    one = lambda *k: first_tag(tags, *k)
    line = lambda *cs: F.nullif(F.concat_ws(" ", *cs), F.lit(""))
    parts = F.concat_ws(", ", line(one("addr:street"), one("addr:housenumber")), line(one("addr:postcode"), one("addr:city")), one("addr:country"))
    return F.coalesce(one("addr:full", "address"), F.nullif(parts, F.lit("")))


def website(c) -> Column:
    """With a scheme."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike("^(?i)https?://"), c).when(c != "", F.concat(F.lit("https://"), c))


def website_label(c) -> Column:
    return F.regexp_replace(F.try_parse_url(website(c), F.lit("HOST")), r"^www\.", "")


def phone_link(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("tel:"), F.regexp_replace(c, r"\s+", ""))


def poi_badge(df: DataFrame, amenities: DataFrame, classes: DataFrame) -> DataFrame:
    """Badge by amenity if it is listed, else by subclass; icon by subclass, then class, then the default. Both dimension tables are (key, badge or icon)."""
    a = amenities.select(F.col("key").alias("amenity"), F.col("badge").alias("_a"))
    s = amenities.select(F.col("key").alias("subclass"), F.col("badge").alias("_s"))
    i = classes.select(F.col("key").alias("subclass"), F.col("icon").alias("_i"))
    j = classes.select(F.col("key").alias("class"), F.col("icon").alias("_j"))
    out = df.join(a, "amenity", "left").join(s, "subclass", "left").join(i, "subclass", "left").join(j, "class", "left")
    return out.withColumn("badge", F.coalesce("_a", "_s")).withColumn("icon", F.coalesce("_i", "_j", F.lit("default"))).drop("_a", "_s", "_i", "_j")


def osm_label(c) -> Column:
    """``fast_food`` as ``Fast Food``; letters after the first stay as they are."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(F.filter(F.split(c, "_"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), " ")


def latest_frame(manifests: DataFrame, template: str) -> DataFrame:
    """URL of each manifest's last frame (frames: array of struct path, time); none is an error text."""
    last = F.element_at("frames", -1)
    before, _, after = template.partition("{}")
    has = F.size("frames") > 0
    return manifests.select("manifest_id", F.when(has, F.concat(F.lit(before), last["path"], F.lit(after))).alias("url"), F.when(~has, "no frame").alias("error"))


def inspect_features(df: DataFrame, keys: list[str], order: list[str], titles: tuple[str, ...], n: int) -> DataFrame:
    """The first n features of each group: properties that are filled, and the first of ``titles`` among them."""
    kept = df.withColumn("properties", F.map_filter("properties", lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False))))
    top = kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)
    return top.withColumn("title", first_tag("properties", *titles))
