"""Steps of a job that are written where all executors can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a local master gets a new one of its own where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-steps-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a written table in that folder, with a folder for each value of the columns ``by``."""
    path = new_path(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{root(spark)}/step-{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of the columns ``order``.

    Rows are sorted into ranges and written once, so that their places stay; each range is numbered on its own and shifted by the
    sizes of those before. One row a range goes through a single window. Rows that tie in all of ``order`` are numbered in any order.
    """
    laid = save(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a partition.
    offsets = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return laid.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
