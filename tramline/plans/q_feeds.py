"""Queries of feed discovery and the version lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discovery as D
from ..operators import versions as V
from ..steps import new_path
from .fixtures import fx, run, whole

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = whole(sql)
        return f

    return add


API = """SELECT c_custkey AS ordinal, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE 'f-' || CAST(c_custkey % 400 AS VARCHAR(20)) END AS onestop_id,
CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ' ' ELSE ' https://x.example/' || CAST(c_custkey % 500 AS VARCHAR(20)) || ' ' END AS url, CASE WHEN c_custkey % 17 = 0 THEN 'header' END AS auth, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS op FROM customer"""
CATALOG = """SELECT s_suppkey AS ordinal, CASE WHEN s_suppkey % 19 = 0 THEN ' ' ELSE ' f-' || CAST(s_suppkey % 60 AS VARCHAR(20)) END AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'gbfs' ELSE ' GTFS' END AS data_type, CASE WHEN s_suppkey % 4 = 0 THEN 'false' ELSE 'TRUE ' END AS official,
CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'P' || s_name END AS provider, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://x.example/' || CAST(s_suppkey % 70 AS VARCHAR(20)) END AS direct, CASE WHEN s_suppkey % 2 = 0 THEN 'https://y.example/' || CAST(s_suppkey AS VARCHAR(20)) END AS latest,
CASE WHEN s_suppkey % 8 = 0 THEN '1' WHEN s_suppkey % 8 = 1 THEN '0' END AS auth FROM supplier"""


def _api(spark, sf):
    d = run(spark, sf, API)
    feeds = d.select("ordinal", "id", "name", "onestop_id", F.struct(F.col("url").alias("static_current")).alias("urls"), F.struct(F.lit(None).cast("string").alias("url")).alias("license"), F.struct(F.col("auth").alias("type")).alias("authorization"), F.array(F.struct(F.lit(None).cast("string").alias("name")), F.struct(F.col("op").alias("name"))).alias("associated_operators"))
    return D.api_sources(feeds)


def _catalog(spark, sf):
    d = run(spark, sf, CATALOG)
    rows = d.select("ordinal", "id", "data_type", F.col("official").alias("is_official"), "name", "provider", F.col("direct").alias("urls.direct_download"), F.col("latest").alias("urls.latest"), F.col("auth").alias("urls.authentication_type"), F.lit(None).cast("string").alias("urls.license"))
    return D.catalog_sources(rows, official=True, no_auth=True)


API_SQL = f"""SELECT ordinal, slug, CASE WHEN trim(name) <> '' THEN name ELSE coalesce(op, slug) END AS name, 'https://example.org/feeds/' || slug AS source_url, trim(url) AS direct_download_url
FROM (SELECT *, CASE WHEN trim(onestop_id) <> '' THEN onestop_id ELSE 'transitland-' || CAST(id AS VARCHAR) END AS slug FROM ({API})) WHERE trim(url) <> '' AND auth IS NULL"""
CATALOG_SQL = f"""SELECT ordinal, trim(id) AS slug, trim(CASE WHEN trim(name) <> '' THEN name ELSE coalesce(provider, trim(id)) END) AS name, 'https://example.org/catalog/' || trim(id) AS source_url, CASE WHEN direct <> '' THEN direct ELSE latest END AS direct_download_url
FROM ({CATALOG}) WHERE lower(trim(data_type)) = 'gtfs' AND lower(trim(official)) = 'true' AND coalesce(auth, '') IN ('', '0') AND (direct <> '' OR latest IS NOT NULL) AND trim(id) <> ''"""


@query(API_SQL)
def api_sources(spark, sf):
    return _api(spark, sf).select("ordinal", "slug", "name", "source_url", "direct_download_url")


@query(CATALOG_SQL)
def catalog_sources(spark, sf):
    return _catalog(spark, sf).select("ordinal", "slug", "name", "source_url", "direct_download_url")


@query(f"""SELECT slug, name, source_url, direct_download_url FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY source_rank DESC, ordinal DESC) AS m FROM (SELECT *, row_number() OVER (PARTITION BY direct_download_url ORDER BY source_rank, ordinal) AS n
FROM (SELECT 0 AS source_rank, * FROM ({API_SQL}) UNION ALL SELECT 1, * FROM ({CATALOG_SQL}))) WHERE n = 1) WHERE m = 1""")
def merged_sources(spark, sf):
    return D.merge_sources(D.discover(_api(spark, sf), _catalog(spark, sf))).select("slug", "name", "source_url", "direct_download_url")


@query("""SELECT page_no, pos AS "at", feed FROM (SELECT CAST(floor(o_orderkey / 100e0) AS INT) AS page_no, o_orderkey % 100 AS pos, o_orderkey AS feed FROM orders) WHERE page_no <= (SELECT floor(max(o_orderkey) / 200e0) FROM orders)""")
def feed_pages(spark, sf):
    d = run(spark, sf, "SELECT CAST(floor(o_orderkey / 100e0) AS INT) AS page_no, CAST(o_orderkey % 100 AS INT) AS pos, o_orderkey, (SELECT CAST(floor(max(o_orderkey) / 200e0) AS INT) FROM orders) AS stop FROM orders")
    pages = d.groupBy("page_no", "stop").agg(F.array_sort(F.collect_list(F.struct("pos", "o_orderkey"))).alias("feeds")).withColumn("after", F.when(F.col("page_no") != F.col("stop"), F.col("page_no")))
    return D.pages_before_stop(pages.drop("stop")).select("page_no", F.col("feed.pos").cast("long").alias("at"), F.col("feed.o_orderkey").alias("feed"))


@query("SELECT s.id AS source_id, s.slug, v.id, v.content_hash FROM dx_sources s JOIN dx_versions v ON v.id = s.active_version_id AND v.source_id = s.id")
def active_versions(spark, sf):
    return V.active_versions(fx(spark, sf, "dx_sources"), fx(spark, sf, "dx_versions")).select("source_id", "slug", "id", "content_hash")


@query("SELECT slug, id, known FROM (SELECT r.slug, s.id, s.id IS NOT NULL AS known FROM (SELECT 'feed-' || CAST(s_suppkey * 20 AS VARCHAR) AS slug FROM supplier) r LEFT JOIN dx_sources s ON s.slug = r.slug)")
def source_requests(spark, sf):
    r = run(spark, sf, "SELECT 'feed-' || CAST(s_suppkey * 20 AS VARCHAR(20)) AS slug FROM supplier")
    return V.source_by_slug(fx(spark, sf, "dx_sources"), r).select("slug", "id", "known")


SEED = "SELECT 'feed-' || CAST(p_partkey * 2 AS VARCHAR(20)) AS slug, p_name AS name, 'https://seed.example/' || CAST(p_partkey AS VARCHAR(20)) AS direct_download_url FROM part"


@query(f"""SELECT coalesce(s.id, t.top + n.k) AS id, coalesce(s.slug, d.slug) AS slug, CASE WHEN d.slug IS NOT NULL THEN d.name ELSE s.name END AS name, CASE WHEN d.slug IS NOT NULL THEN d.direct_download_url ELSE s.direct_download_url END AS direct_download_url, s.active_version_id, d.slug IS NOT NULL AS updated
FROM dx_sources s FULL JOIN ({SEED}) d ON d.slug = s.slug LEFT JOIN (SELECT slug, row_number() OVER (ORDER BY slug) AS k FROM ({SEED}) WHERE slug NOT IN (SELECT slug FROM dx_sources)) n ON n.slug = d.slug, (SELECT max(id) AS top FROM dx_sources) t""")
def upserted_sources(spark, sf):
    old = fx(spark, sf, "dx_sources").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    out = V.upsert_sources(old, run(spark, sf, SEED), F.lit("2024-06-01").cast("timestamp"), ["name", "direct_download_url"])
    return out.select("id", "slug", "name", "direct_download_url", "active_version_id", (F.col("updated_at") == F.lit("2024-06-01").cast("timestamp")).alias("updated"))


@query(f"SELECT s.id, s.slug, v.id AS version_id FROM dx_sources s LEFT JOIN dx_versions v ON v.source_id = s.id WHERE s.slug IN (SELECT slug FROM ({SEED}))")
def pruned_sources(spark, sf):
    s, v = V.prune_missing(fx(spark, sf, "dx_sources"), fx(spark, sf, "dx_versions"), run(spark, sf, SEED))
    return s.join(v.select(F.col("source_id").alias("id"), F.col("id").alias("version_id")), "id", "left").select("id", "slug", "version_id")


CANDIDATES = "SELECT CAST(c_custkey + 1 AS BIGINT) AS source_id, c_custkey % 5 = 0 AS not_modified, md5(CAST((c_custkey * 3) % 50 AS VARCHAR(20))) AS content_hash FROM customer"
DECISIONS = f"""SELECT c.source_id, c.content_hash, v.id AS active_id, CASE WHEN c.not_modified AND v.id IS NULL THEN 'error' WHEN c.not_modified THEN 'not_modified' WHEN c.content_hash = v.content_hash THEN 'same_hash' ELSE 'new_version' END AS outcome
FROM ({CANDIDATES}) c LEFT JOIN dx_sources s ON s.id = c.source_id LEFT JOIN dx_versions v ON v.id = s.active_version_id AND v.source_id = s.id"""


def _decisions(spark, sf):
    return V.decide_changes(run(spark, sf, CANDIDATES), fx(spark, sf, "dx_sources"), fx(spark, sf, "dx_versions"))


@query(DECISIONS)
def change_decisions(spark, sf):
    return _decisions(spark, sf)


@query(f"""SELECT CAST(t.top + row_number() OVER (ORDER BY d.source_id) AS INT) AS id, d.source_id, 'feed-sources/' || s.slug || '/versions/' || d.content_hash || '.zip' AS file_path, 'downloaded' AS status
FROM ({DECISIONS}) d JOIN dx_sources s ON s.id = d.source_id, (SELECT max(id) AS top FROM dx_versions) t WHERE d.outcome = 'new_version'""")
def new_versions(spark, sf):
    out = V.new_versions(_decisions(spark, sf), fx(spark, sf, "dx_sources"), fx(spark, sf, "dx_versions"), F.lit("2024-06-01").cast("timestamp"))
    return out.select("id", "source_id", "file_path", "status")


@query("SELECT id, CASE WHEN id % 6 = 1 THEN 'new-' || CAST(id AS VARCHAR) ELSE http_etag END AS http_etag FROM dx_versions")
def refreshed_validators(spark, sf):
    v = fx(spark, sf, "dx_versions")
    fresh = v.filter("id % 3 = 1").select("id", F.when(F.col("id") % 6 == 1, F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("http_etag"))
    return V.refresh_validators(v, fresh, ["http_etag"]).select("id", "http_etag")


@query("""SELECT id, CASE WHEN status IN ('imported', 'active') THEN 'skip' ELSE 'import' END AS action, CASE WHEN status IN ('imported', 'active') THEN status ELSE 'imported' END AS new_status,
CASE WHEN id % 2 = 1 AND status NOT IN ('imported', 'active') THEN 'import_failed' ELSE status END AS failed_status, CASE WHEN id % 2 = 1 AND status NOT IN ('imported', 'active') THEN 'bad file' END AS error_message FROM dx_versions""")
def import_gates(spark, sf):
    v = fx(spark, sf, "dx_versions")
    failed = V.mark_failed(v, v.filter("id % 2 = 1").select("id", F.lit("bad file").alias("error_message"))).select("id", F.col("status").alias("failed_status"), "error_message")
    return V.import_gate(v).select("id", "action", "new_status").join(failed, "id")


PICKED = "SELECT max(id) AS id FROM dx_versions WHERE status <> 'downloaded' GROUP BY source_id"
OUTCOMES = f"""SELECT v.id, v.source_id, a.id AS active_id, CASE WHEN v.status = 'active' THEN 'already_active' WHEN v.status <> 'imported' THEN 'not_imported' WHEN a.fetched_at > v.fetched_at THEN 'stale' ELSE 'promoted' END AS outcome
FROM dx_versions v JOIN ({PICKED}) p ON p.id = v.id LEFT JOIN dx_sources s ON s.id = v.source_id LEFT JOIN dx_versions a ON a.id = s.active_version_id AND a.source_id = s.id"""


def _promoted(spark, sf):
    v = fx(spark, sf, "dx_versions")
    return V.promote(fx(spark, sf, "dx_sources"), v, v.filter("status != 'downloaded'").groupBy("source_id").agg(F.max("id").alias("id")))


@query(OUTCOMES)
def promotion_outcomes(spark, sf):
    return _promoted(spark, sf)[2]


@query(f"""SELECT v.id, v.source_id, CASE WHEN v.id = w.id THEN 'active' WHEN w.id IS NOT NULL AND v.status = 'active' THEN 'imported' ELSE v.status END AS status, coalesce(w.id, s.active_version_id) AS active_version_id
FROM dx_versions v LEFT JOIN (SELECT * FROM ({OUTCOMES}) WHERE outcome = 'promoted') w ON w.source_id = v.source_id LEFT JOIN dx_sources s ON s.id = v.source_id""")
def promoted_versions(spark, sf):
    s, v, _ = _promoted(spark, sf)
    return v.select("id", "source_id", "status").join(s.select(F.col("id").alias("source_id"), "active_version_id"), "source_id", "left")


@query(f"SELECT outcome, count(*) AS n, outcome IN ('promoted', 'already_active') AS succeeded FROM ({OUTCOMES}) GROUP BY 1")
def sync_summary(spark, sf):
    return V.sync_summary(_promoted(spark, sf)[2], ("promoted", "already_active"))


ARTIFACTS = "SELECT CAST(floor(c_custkey / 100e0) AS BIGINT) AS feed, c_custkey, c_name || ',' || c_mktsegment AS line FROM customer"


@query(f"SELECT 'feed-' || CAST(feed AS VARCHAR) || '.zip' AS artifact, sha256(string_agg(line, chr(10) ORDER BY c_custkey)) AS content_sha256, CAST(sum(length(line) + 1) - 1 AS BIGINT) AS file_bytes FROM ({ARTIFACTS}) GROUP BY feed")
def artifact_hashes(spark, sf):
    """Artifacts and notes as files; hash and size of the artifacts."""
    from ..sources import readers, sinks

    d = run(spark, sf, ARTIFACTS).groupBy("feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda r: r["line"]), "\n").alias("content"))
    root = new_path(spark)
    name = F.concat(F.lit("feed-"), F.col("feed").cast("string"))
    sinks.write_files(d.select(F.concat(name, F.lit(".zip")).alias("path"), "content").unionByName(d.select(F.concat(name, F.lit(".note")).alias("path"), F.lit("not a feed").alias("content"))), root)
    return V.hash_artifacts(readers.read_artifacts(spark, root)).select(F.element_at(F.split("path", "/"), -1).alias("artifact"), "content_sha256", "file_bytes")


@query("SELECT c_custkey, c_custkey % 4 <> 1 AS ok FROM customer")
def artifact_types(spark, sf):
    c = run(spark, sf, "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' Application/ZIP ; charset=x' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/octet-stream' END AS ct FROM customer")
    return c.select("c_custkey", V.is_feed_media_type("ct").alias("ok"))


@query("SELECT slug FROM dx_sources")
def source_slugs(spark, sf):
    return V.list_slugs(fx(spark, sf, "dx_sources"))
