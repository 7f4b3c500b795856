"""A corpus pipeline out of the operators of tramline.llm: toxic texts, copies and near copies go, secrets are blanked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bm25_packing, exact_dedup, ngram_join, secret_scan, toxicity
from tramline.llm.common import materialise, partitions, scratch, table, unused

#: What stands in a text where a secret stood.
MARK = "[SECRET]"
#: Pieces that the packing stage's workers remember: few, as the stages before leave little memory free.
REMEMBERED = 100_000


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names, which a stage makes anew, under other ones; and the way back."""
    taken = {c: unused(f"_{c}", *docs.columns) for c in docs.columns if c in names}
    return docs.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted to the training part of ``labels``."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    own, back = _aside(docs, "score", "evidence")
    return toxicity.scores(own, model, evidence=False).filter(F.col("score") < toxicity.TOXIC).select(*own.columns).withColumnsRenamed(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, scratch(spark, "digests"), max(8, partitions(spark)))
    return exact_dedup.kept_rows(docs, index)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, by its smallest doc_id: five-word grams, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, 5, 80)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret's span is replaced by MARK, and n_chars follows."""
    own, back = _aside(docs, "spans")
    clean = secret_scan.scan(own, redact=MARK).drop("spans").withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    import public_tokenizers

    return bm25_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, remembered=REMEMBERED)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("secret_scan", blank_secrets), ("packing", pack)]

#: Learned scores and token ids have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, f"stage-{name}")
    return docs
