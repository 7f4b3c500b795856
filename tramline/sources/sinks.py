"""Sinks: versions replaced whole, counted writes, tiles in order, named files, manifests appended."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import spatial as S


def overwrite_versions(df: DataFrame, path: str) -> None:
    """Replace the versions that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(path)


def reconcile_counts(produced: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of rows differs between both sides."""
    a, b = produced.groupBy(*keys).agg(F.count(F.lit(1)).alias("produced")), written.groupBy(*keys).agg(F.count(F.lit(1)).alias("written"))
    both = a.join(b, keys, "full_outer").fillna(0, ["produced", "written"])
    return both.filter("produced != written")


class CountMismatch(Exception):
    """A write took another number of rows than were produced."""


def write_counted(df: DataFrame, path: str, accepted: Column | None = None) -> tuple[int, int]:
    """Write ``df`` (of which only the rows that are ``accepted``) and give the numbers of rows produced and written; that they differ is an error.

    Rows are counted while they are written, so ``df`` is computed once; what was written is counted from the files' footers.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    (rows if accepted is None else rows.filter(accepted)).write.mode("overwrite").parquet(path)
    produced, written = int(seen.get["n"]), df.sparkSession.read.schema(df.schema).parquet(path).count()
    if produced != written:
        raise CountMismatch(f"{produced} rows were produced, {written} are in {path}")
    return produced, written


def uri(root: str) -> str:
    """A folder as pyarrow's file systems name it."""
    return root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else f"file://{root}"


def write_files(df: DataFrame, root: str) -> int:
    """One file for each row of (path, content): texts or bytes below ``root``, written by the tasks that have the rows; their number.

    A path may not leave ``root``. A task that runs again writes the same files again; of rows with one path any is left.
    """
    at = uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(at)
        made = None
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = path.split("/")
                if ".." in parts or not parts[-1]:
                    raise ValueError(f"not a path below the root: {path}")
                target = "/".join([base.rstrip("/"), *[p for p in parts if p]])
                if (folder := target.rpartition("/")[0]) != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(target) as out:
                    out.write(bytes(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_tiles(df: DataFrame, path: str, partitions: int = 64) -> None:
    """Tiles (z, x, y, ...) in ranges of their address, sorted; no tile at all is an error."""
    if df.isEmpty():
        raise ValueError("there are no tiles")
    df.repartitionByRange(partitions, "z", "x", "y").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z").parquet(path)


def tileset_metadata(tiles: DataFrame, fields: DataFrame, name: str) -> DataFrame:
    """One row: TileJSON text of tiles (z, x, y) with the layers of ``fields`` (layer, key, type)."""
    b = tiles.withColumn("_b", S.tile_bounds("z", "x", "y"))
    one = b.agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"), F.min("_b.west").alias("w"), F.min("_b.south").alias("s"), F.max("_b.east").alias("e"), F.max("_b.north").alias("n"))
    layers = fields.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("key", "type"))).alias("fields")).agg(F.array_sort(F.collect_list(F.struct(F.col("layer").alias("id"), "fields"))).alias("vector_layers"))
    r = lambda c: F.round(c, 6)
    text = F.to_json(F.struct(F.lit("3.0.0").alias("tilejson"), F.lit(name).alias("name"), "minzoom", "maxzoom", F.array(r("w"), r("s"), r("e"), r("n")).alias("bounds"), F.array(r((F.col("w") + F.col("e")) / 2), r((F.col("s") + F.col("n")) / 2)).alias("center"), "vector_layers"))
    return one.crossJoin(layers).select(text.alias("json"))


def append_manifest(df: DataFrame, path: str) -> None:
    df.select("path", "bounds").write.mode("append").parquet(path)
