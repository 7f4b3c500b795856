"""Exact dedup against a persistent digest index.

The index is a Parquet table, bucketed and sorted by ``digest``, with one row for each distinct text seen so far:
``digest`` (SHA-256 of the normalised text), ``keep_id``, ``n_points`` and ``group_size`` at the time it was added.
A new batch is reduced to one row a digest, joined to the index by a sort-merge anti-join, and what is new is appended in
the same buckets. The index side is not shuffled; while a bucket has one file it is not sorted anew either, after further
appends Spark sorts the bucket's files together, until ``compact`` has made them one.

The number of buckets and the current generation of files are kept beside the data, in ``_about``: an index opened again, in
any session and with any settings, has the buckets it was made with. ``compact`` writes a new generation, in a new folder, and then names it
there, so one that is cut off leaves the old one in force. One writer at a time.

Defined cases: a null text counts as empty; texts that differ in ASCII white space alone are equal; of equal texts the
one with most code points stays, then the smallest id, then (repeated rows) one row of that id, and rows with a null id lose against
all others. An empty batch appends nothing. Further columns pass through ``kept_rows``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, partitions, scratch, table, unused

#: Parts into which the rows of one digest are dealt before anything needs them together.
SALTS = 64
#: What is kept beside an index: its generations, each with its buckets and its folder.
ABOUT = "generation int, buckets int, folder string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc id, digest, code points of the original text and a salt that spreads hot digests."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("n_points"),
        # Rows without an id are dealt by their place, so what this gives must be written before it is used twice.
        F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col))), F.lit(SALTS)).cast("int").alias("salt"),
    )


def groups(hashed: DataFrame) -> DataFrame:
    """A row for each digest: the id that stays, its code points, the group's size and the salts at which it has rows.

    Two steps: no task ever holds more of a group than one row for each salt.
    """
    # Ids count from the smallest; a null id loses.
    best = F.max_by(F.struct("doc_id", "n_points"), F.struct("n_points", F.col("doc_id").isNotNull(), -F.col("doc_id")))
    parts = hashed.groupBy("digest", "salt").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    best = F.max_by("b", F.struct(F.col("b.n_points"), F.col("b.doc_id").isNotNull(), -F.col("b.doc_id")))
    return parts.groupBy("digest").agg(best.alias("b"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")).select(
        "digest", F.col("b.doc_id").alias("keep_id"), F.col("b.n_points").alias("n_points"), "group_size", "salts"
    )


class DigestIndex:
    """The persistent index at ``path``; an existing one is opened again. ``buckets`` counts for a new one alone.

    Each generation of it has a folder of a name of its own, which ``_about`` names, with the number of buckets, once it is whole. So a
    compaction that is broken off anywhere leaves the index as it was, and nothing that it left is ever looked at.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        about = f"{self.path}/_about"
        try:
            found = spark.read.schema(ABOUT).parquet(about).orderBy(F.desc("generation"), "folder").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        if found is None:
            found = (0, buckets, self._folder(0))
            self._name(*found)
        self._open(*found)

    def _folder(self, generation: int) -> str:
        return f"generation-{generation}-{uuid.uuid4().hex[:12]}"

    def _name(self, generation: int, buckets: int, folder: str) -> None:
        self.spark.createDataFrame([(generation, buckets, folder)], ABOUT).coalesce(1).write.mode("append").parquet(f"{self.path}/_about")

    def _entry(self, buckets: int, folder: str) -> str:
        """The catalogue's entry of a folder, made where it is not there."""
        location = f"{self.path}/{folder}"
        name = "digest_index_" + hashlib.sha256(location.encode()).hexdigest()[:24]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, n_points BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        # Another session may have appended since this one last looked.
        self.spark.catalog.refreshTable(name)
        return name

    def _open(self, generation: int, buckets: int, folder: str) -> None:
        self.generation, self.buckets, self.name = generation, buckets, self._entry(buckets, folder)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, found: DataFrame) -> None:
        """Add the digests of ``found`` (as from ``groups``) that the index lacks."""
        new = found.select("digest", "keep_id", "n_points", "group_size").repartition(self.buckets, "digest")
        new = new.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        new.sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, buckets: int | None = None) -> None:
        """Write all rows as one file a bucket, as a new generation, with another number of buckets if given. The old files stay."""
        generation, buckets = self.generation + 1, buckets or self.buckets
        folder = self._folder(generation)
        name = self._entry(buckets, folder)
        self.rows().repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(name, overwrite=True)
        self.spark.catalog.refreshTable(name)
        self._name(generation, buckets, folder)
        self._open(generation, buckets, folder)

    def dedup(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
        """Append the batch's new texts; return (doc_id, digest, keep_id, group_size, kept) for each of its rows.

        ``group_size`` counts the rows of the batch that first brought the text. In later batches nothing equal to an indexed text is
        kept but the row with the id that stays: a batch that is given again, as after a failure, has the results that it had. Texts are
        read and hashed once; ids and digests are written.
        """
        hashed = materialise(digests(docs, text, id_col), "hashed")
        found = groups(hashed)
        self.append(found)
        # A digest's row is repeated only for the salts at which it has rows, so a hot one meets its rows in SALTS tasks.
        known = found.select("digest", F.explode("salts").alias("salt")).join(self.rows().hint("merge"), "digest")
        known = known.select("digest", "salt", "keep_id", "group_size")
        out = hashed.join(known, ["digest", "salt"])
        # Of repeated rows with the id that stays, the batch keeps one; see kept_rows.
        return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "n_points")


def kept_rows(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one row a text."""
    own_id, own_digest = unused("_id", *docs.columns), unused("_digest", *docs.columns)
    kept = index.dedup(docs, text, id_col).filter("kept").select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.sha2(normalised(F.col(text)), 256).alias(own_digest), F.col(id_col).alias(own_id))
    rows = rows.join(kept, (rows[own_digest] == kept["d"]) & rows[own_id].eqNullSafe(kept["i"]), "left_semi")
    # Rows that share id and text are exact repeats as far as this operator goes.
    return rows.dropDuplicates([own_id, own_digest]).drop(own_id, own_digest)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, scratch(spark, "digests"), max(8, partitions(spark)))
    return index.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
