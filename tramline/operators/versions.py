"""Feed-version lifecycle as transitions of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import numbered

# Media types that a feed may have.
MEDIA_TYPES = ("application/zip", "application/x-zip-compressed", "application/octet-stream", "binary/octet-stream", "application/x-zip")


def list_slugs(sources: DataFrame) -> DataFrame:
    return sources.select("slug").orderBy("slug")


def source_by_slug(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested slugs with their source; ``known`` is false for those without one."""
    return requests.join(sources.withColumn("_k", F.lit(True)), "slug", "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


def active_versions(sources: DataFrame, versions: DataFrame) -> DataFrame:
    own = sources.select(F.col("id").alias("source_id"), "slug", F.col("active_version_id").alias("id"))
    return own.join(versions, ["id", "source_id"])


def version_by_id(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested ids with their version; ``known`` is false for those without one."""
    return requests.join(versions.withColumn("_k", F.lit(True)), "id", "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_k")


def upsert_sources(sources: DataFrame, seed: DataFrame, now: Column, columns: list[str]) -> DataFrame:
    """Sources with the seed's values for ``columns``; new slugs get the next ids by slug; id and created_at stay."""
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = seed.join(sources.select("slug"), "slug", "left_anti").select("slug")
    fresh = numbered(fresh, ["slug"], "_n").crossJoin(F.broadcast(top)).select("slug", (F.col("_top") + F.col("_n")).alias("_id"))
    s, d = sources.alias("s"), seed.select("slug", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_in")).alias("d")
    both = s.join(d, "slug", "full_outer").join(fresh, "slug", "left")
    return both.select(
        F.coalesce("id", "_id").alias("id"), "slug", *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], "active_version_id",
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("_in"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def prune_missing(sources: DataFrame, versions: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources in the seed, and their versions."""
    kept = sources.join(seed.select("slug").distinct(), "slug", "left_semi")
    return kept, versions.join(kept.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def hash_artifacts(files: DataFrame) -> DataFrame:
    """SHA-256 and size of files as from the ``binaryFile`` source."""
    return files.select("path", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("long").alias("file_bytes"))


def decide_changes(candidates: DataFrame, sources: DataFrame, versions: DataFrame) -> DataFrame:
    """Outcome of each candidate (source_id, not_modified, content_hash): not_modified needs an active version, else it is an error."""
    active = active_versions(sources, versions).select("source_id", F.col("id").alias("active_id"), F.col("content_hash").alias("_hash"))
    met = candidates.join(active, "source_id", "left")
    outcome = (
        F.when(F.col("not_modified") & F.col("active_id").isNull(), "error").when(F.col("not_modified"), "not_modified")
        .when(F.col("content_hash") == F.col("_hash"), "same_hash").otherwise("new_version")
    )
    return met.select("source_id", "content_hash", "active_id", outcome.alias("outcome"))


def new_versions(decisions: DataFrame, sources: DataFrame, versions: DataFrame, fetched_at: Column) -> DataFrame:
    """``downloaded`` rows for the new versions, with the next ids by source."""
    top = versions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    own = decisions.filter("outcome = 'new_version'").join(sources.select(F.col("id").alias("source_id"), "slug"), "source_id")
    own = numbered(own, ["source_id"], "_n").crossJoin(F.broadcast(top))
    path = F.concat(F.lit("feed-sources/"), "slug", F.lit("/versions/"), "content_hash", F.lit(".zip"))
    return own.select((F.col("_top") + F.col("_n")).cast("int").alias("id"), "source_id", "content_hash", path.alias("file_path"), F.lit("downloaded").alias("status"), fetched_at.alias("fetched_at"))


def refresh_validators(versions: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """New values of ``columns`` where ``fresh`` (id, columns) has them, else the old ones."""
    own = fresh.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    met = versions.join(own, "id", "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in versions.columns])


def import_gate(versions: DataFrame) -> DataFrame:
    s = F.col("status")
    action = F.when(s.isin("imported", "active"), "skip").when(s.isin("downloaded", "import_failed"), "import").otherwise("error")
    return versions.select("id", "source_id", "status", action.alias("action"), F.when(action == "import", "imported").otherwise(s).alias("new_status"))


def mark_failed(versions: DataFrame, failures: DataFrame) -> DataFrame:
    """``import_failed`` for versions in ``failures`` (id, error_message), unless they are imported or active."""
    met = versions.join(failures.select("id", F.col("error_message").alias("_e")), "id", "left")
    hit = F.col("_e").isNotNull() & ~F.col("status").isin("imported", "active")
    return met.withColumn("error_message", F.when(hit, F.col("_e"))).withColumn("status", F.when(hit, "import_failed").otherwise(F.col("status"))).drop("_e")


def promote(sources: DataFrame, versions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New sources, new versions, and outcomes of ``candidates`` (id; one a source): promoted, already_active, stale or not_imported.

    Only an imported version is promoted, and not if the active one was fetched strictly later. The others that are
    active in its source become imported.
    """
    active = active_versions(sources, versions).select("source_id", F.col("id").alias("active_id"), F.col("fetched_at").alias("_at"))
    met = versions.join(candidates.select("id").distinct(), "id", "left_semi").join(active, "source_id", "left")
    outcome = (
        F.when(F.col("status") == "active", "already_active").when(F.col("status") != "imported", "not_imported")
        .when(F.col("_at") > F.col("fetched_at"), "stale").otherwise("promoted")
    )
    outcomes = met.select("id", "source_id", "active_id", outcome.alias("outcome"))
    won = outcomes.filter("outcome = 'promoted'").select("source_id", F.col("id").alias("_won"))
    after = versions.join(won, "source_id", "left")
    status = F.when(F.col("id") == F.col("_won"), "active").when(F.col("_won").isNotNull() & (F.col("status") == "active"), "imported").otherwise(F.col("status"))
    pointer = sources.join(won.withColumnRenamed("source_id", "id"), "id", "left").withColumn("active_version_id", F.coalesce("_won", "active_version_id")).drop("_won")
    return pointer, after.withColumn("status", status).drop("_won"), outcomes


def sync_summary(outcomes: DataFrame, ok: tuple[str, ...]) -> DataFrame:
    """Number of sources in each outcome, and whether it counts as success."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("succeeded", F.col("outcome").isin(*ok))


def is_feed_media_type(c) -> Column:
    """Whether a content-type header names a feed; no header passes."""
    c = c if isinstance(c, Column) else F.col(c)
    return c.isNull() | F.lower(F.trim(F.substring_index(c, ";", 1))).isin(*MEDIA_TYPES)
