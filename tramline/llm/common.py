"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular-expression class.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Rows that Python tasks turn over at a time; texts may be long.
SLICE = 500
#: Rows that are encoded together: the more, the rarer a distinct piece is looked up.
TOGETHER = 2000
#: Bytes of text that go together, unless one text alone is longer.
PORTION = 3 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none and its master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else "file://" + os.path.abspath(root)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return posixpath.join(shared_root(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *columns: str) -> str:
    """``name``, lengthened until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, rows: int = TOGETHER, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``rows`` rows whose texts in ``column`` have up to ``size`` bytes together."""
    for batch in slices(batches, rows):
        ends = np.cumsum(pc.binary_length(batch.column(column if column >= 0 else batch.num_columns + column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def by_range(df: DataFrame, key: str, n: int, *ties: str, context: bool = False, weight: str | None = None) -> DataFrame:
    """Partition ``df`` by ranges of ``key`` and sort each partition by ``key`` and ``ties`` (nulls first).

    Ranges have like numbers of rows, or like sums of the column ``weight``.

    The bounds are quantiles of the key column alone, one value for each partition, so a first job reads no other
    column and every execution deals the rows out alike. With ``context``, column ``_context`` is added: each
    partition also begins with the last row before it (the first partition: with the last row of all), marked true.
    """
    bounds = quantiles(df, key, n) if weight is None else weighted_quantiles(df, key, n, weight)
    own = df.withColumn("_part", _below(F.col(key), bounds))
    if context:
        # A partition's largest key is its bound, so the row that the next one needs is known here.
        top = df.agg(F.max(key)).first()[0]
        copies = F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("c")))
        if bounds:
            copies = F.when(F.col(key).isin(bounds), F.concat(copies, F.array(F.struct((F.col("_part") + 1).alias("p"), F.lit(True).alias("c"))))).otherwise(copies)
        copies = F.when(F.col(key) == top, F.concat(copies, F.array(F.struct(F.lit(0).alias("p"), F.lit(True).alias("c"))))).otherwise(copies)
        own = own.select(*df.columns, F.inline(copies)).withColumnsRenamed({"p": "_part", "c": "_context"})
    dealt = own.repartitionById(len(bounds) + 1, F.col("_part"))
    return dealt.sortWithinPartitions(*([F.col("_context").desc()] if context else []), F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])


def _below(of: Column, bounds: list[int]) -> Column:
    """How many of the increasing ``bounds`` lie below ``of`` (null: none), by binary search."""
    if not bounds:
        return F.lit(0)
    edges, steps = F.lit(bounds), F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(edges, at + s - 1) < of), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def weighted_quantiles(df: DataFrame, key: str, n: int, weight: str, fine: int = 16) -> list[int]:
    """As ``quantiles``, for about equal sums of ``weight``: bounds of ``fine`` times as many ranges, of which those nearest to each share stay."""
    bounds = quantiles(df, key, fine * n)
    if not bounds:
        return []
    # One row a fine range, so at most fine * n of them.
    sums = dict(df.groupBy(_below(F.col(key), bounds).alias("r")).agg(F.sum(weight)).collect())
    upto = np.cumsum([float(sums.get(r) or 0) for r in range(len(bounds) + 1)])
    at = np.searchsorted(upto[:-1], [upto[-1] * k / n for k in range(1, n)])
    return sorted({bounds[min(int(k), len(bounds) - 1)] for k in at})


def quantiles(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 increasing values of ``key`` that cut its rows into about n equal ranges; the largest value is none of them."""
    if n < 2:
        return []
    found, top = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 20 * n)), F.max(key)).first()
    return sorted({b for b in found or [] if b != top})
