"""Feed discovery: catalogue rows to one seed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import numbered

SEED = ["slug", "name", "source_url", "direct_download_url", "license_url", "attribution"]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def filled(c) -> Column:
    """A text that is more than white space, else null."""
    return F.when(F.trim(_c(c)) != "", _c(c))


def eq_ci(c, text: str) -> Column:
    """Equal when trimmed and in any ASCII case; null is equal to nothing."""
    return F.coalesce(F.lower(F.trim(_c(c))) == text.strip().lower(), F.lit(False))


def api_sources(feeds: DataFrame, template: str = "https://example.org/feeds/{}", require_url: bool = True, allow_authorization: bool = False) -> DataFrame:
    """Seed rows of API feeds (id, name, onestop_id, urls.static_current, license.url, authorization.type, associated_operators[name])."""
    url = F.trim("urls.static_current")
    rows = feeds.filter(url.isNotNull())
    if require_url:
        rows = rows.filter(url != "")
    if not allow_authorization:
        rows = rows.filter(F.col("authorization.type").isNull())
    slug = F.coalesce(filled("onestop_id"), F.concat(F.lit("transitland-"), F.col("id").cast("string")))
    operator = F.get(F.filter("associated_operators", lambda o: o["name"].isNotNull()), F.lit(0))["name"]
    before, _, after = template.partition("{}")
    return rows.select(
        slug.alias("slug"), F.coalesce(filled("name"), operator, slug).alias("name"), F.concat(F.lit(before), slug, F.lit(after)).alias("source_url"),
        url.alias("direct_download_url"), F.col("license.url").alias("license_url"), F.lit(None).cast("string").alias("attribution"), "ordinal",
    )


def catalog_sources(rows: DataFrame, template: str = "https://example.org/catalog/{}", official: bool = False, no_auth: bool = False, countries: list[str] | None = None, status: str | None = None, require_url: bool = True) -> DataFrame:
    """Seed rows of a catalogue table with dotted column names."""
    c = lambda name: F.col(f"`{name}`")
    out = rows.filter(eq_ci(c("data_type"), "gtfs"))
    if official:
        out = out.filter(eq_ci(c("is_official"), "true"))
    if no_auth:
        out = out.filter(F.coalesce(F.trim(c("urls.authentication_type")), F.lit("")).isin("", "0"))
    if countries:
        wanted = [x.strip().lower() for x in countries]
        out = out.filter(F.lower(F.trim(c("location.country_code"))).isin(*wanted))
    if status:
        out = out.filter(eq_ci(c("status"), status))
    url = F.trim(F.coalesce(filled(c("urls.direct_download")), filled(c("urls.latest"))))
    if require_url:
        out = out.filter(url.isNotNull())
    slug = F.trim(c("id"))
    before, _, after = template.partition("{}")
    return out.filter(slug != "").select(
        slug.alias("slug"), F.trim(F.coalesce(filled(c("name")), filled(c("provider")), slug)).alias("name"), F.concat(F.lit(before), slug, F.lit(after)).alias("source_url"),
        url.alias("direct_download_url"), filled(c("urls.license")).alias("license_url"), filled(c("provider")).alias("attribution"), "ordinal",
    )


def discover(api: DataFrame, catalog: DataFrame) -> DataFrame:
    """Both lists as one, API rows first."""
    return api.withColumn("source_rank", F.lit(0)).unionByName(catalog.withColumn("source_rank", F.lit(1)))


def merge_sources(rows: DataFrame) -> DataFrame:
    """First row for each trimmed URL, then of those the last for each slug.

    A URL that went to a row which then loses its slug stays taken. Both steps are aggregates with map-side parts.
    """
    at = F.struct("source_rank", "ordinal")
    row = F.struct(*SEED, "source_rank", "ordinal")
    first = rows.groupBy(F.trim("direct_download_url").alias("_u")).agg(F.min_by(row, at).alias("r")).select("r.*")
    return first.groupBy("slug").agg(F.max_by(row, at).alias("r")).select("r.*").select(*SEED)


def pages_before_stop(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Feeds of landed pages (page_no, feeds, after) up to and with the first page that has no successor; an empty page ends the reading before it."""
    own = pages if max_pages is None else pages.filter(F.col("page_no") <= max_pages)
    stop = own.agg(F.min(F.when(F.col("after").isNull() | (F.size("feeds") == 0), F.col("page_no"))).alias("_stop"))
    kept = own.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col("page_no") <= F.col("_stop")))
    return kept.select("page_no", F.posexplode("feeds").alias("at", "feed"))


def ordered_by_slug(rows: DataFrame) -> DataFrame:
    return numbered(rows, ["slug"], "place")
