"""Readers: schedule files, catalogues, map elements, GeoJSON, chunk and image manifests, tile listings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gtfs_import import SPECS
from .sinks import uri

REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
OPTIONAL = ("calendar", "calendar_dates", "shapes", "feed_info")
#: Byte-order mark, as some exporters leave it before the first header.
MARK = "﻿"


def read_gtfs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as text, headers without mark and outer space, values as they stand; with ``file`` (base name) and row place in ``row_ord``.

    Rows may be of any width: cells that a short row lacks are null, those that a long one has beyond the header are left out. What does not
    read as its type is for ``gtfs_import.load`` (``strict``: fails with file and row) or ``gtfs_import.sorted_out`` to find.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "").option("inferSchema", False).csv(paths)
    named = raw.toDF(*[c.lstrip(MARK).strip() for c in raw.columns])
    return named.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("row_ord", F.monotonically_increasing_id())


def empty(spark: SparkSession, name: str) -> DataFrame:
    """No rows, with the raw columns of a file: what an absent optional file stands for."""
    fields = [T.StructField(source, T.StringType()) for source, _ in SPECS[name].values()]
    return spark.createDataFrame([], T.StructType([*fields, T.StructField("file", T.StringType()), T.StructField("row_ord", T.LongType())]))


def read_artifacts(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """(path, modified_at, length, content) of the files below ``root`` whose names match; columns that a job doesn't use are not read. Empty files are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), "length", "content")


def feed_members(listing: DataFrame) -> DataFrame:
    """(member, path) of a listing (path, ordinal): files by base name in any folder; of equal names the last one counts."""
    base = F.element_at(F.split("path", "/"), -1)
    own = listing.withColumn("member", F.regexp_replace(base, r"\.txt$", "")).filter(base.isin(*[f"{n}.txt" for n in REQUIRED + OPTIONAL]))
    return own.groupBy("member").agg(F.max_by("path", "ordinal").alias("path"))


def missing_required(members: DataFrame) -> DataFrame:
    spark = members.sparkSession
    wanted = spark.createDataFrame([(n,) for n in REQUIRED], "member string")
    return wanted.join(members, "member", "left_anti")


def read_feed(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Raw tables of a feed; optional files that are absent are empty, required ones an error."""
    lost = [n for n in REQUIRED if n not in paths]
    if lost:
        raise FileNotFoundError(f"required files are missing: {', '.join(lost)}")
    return {n: read_gtfs(spark, paths[n]) if n in paths else empty(spark, n) for n in REQUIRED + OPTIONAL}


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue with dotted headers, all text, with ``ordinal``."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).withColumn("ordinal", F.monotonically_increasing_id())


FEED = "struct<id: long, name: string, onestop_id: string, urls: struct<static_current: string>, license: struct<url: string>, authorization: struct<type: string>, associated_operators: array<struct<name: string>>>"


def read_catalog_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages as (page_no, feeds, after); the page number is the last one in the file's base name."""
    pages = spark.read.schema(f"feeds array<{FEED}>, meta struct<after: long>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return pages.select(F.regexp_extract(F.input_file_name(), r"(\d+)[^\d/]*$", 1).cast("int").alias("page_no"), F.coalesce("feeds", F.array().cast(f"array<{FEED}>")).alias("feeds"), F.col("meta.after").alias("after"))


SEED = "slug string, name string, source_url string, direct_download_url string, license_url string, attribution string"


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED).json(path)


def write_seed(seed: DataFrame, path: str) -> None:
    seed.select(*[c.split()[0] for c in SEED.split(", ")]).write.mode("overwrite").json(path)


OSM = "osm_type string, osm_key long, attrs struct<version: int, timestamp: string>, tags map<string, string>, geom string"


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements from JSON lines; a key is (osm_type, osm_key)."""
    return spark.read.schema(OSM).json(path)


def geojson_features(texts: DataFrame, column: str = "value") -> DataFrame:
    """Features of GeoJSON texts: collections, single features and bare geometries (features without properties). Properties are a map of text; positions are one flat array."""
    kind = F.get_json_object(column, "$.type")
    many = F.from_json(F.col(column), "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>")["features"]
    one = F.from_json(F.col(column), "properties map<string, string>, geometry struct<type: string, coordinates: string>")
    bare = F.from_json(F.col(column), "type string, coordinates string")
    item = F.struct(one["properties"].alias("properties"), one["geometry"].alias("geometry"))
    alone = F.struct(F.lit(None).cast("map<string, string>").alias("properties"), F.struct(bare["type"].alias("type"), bare["coordinates"].alias("coordinates")).alias("geometry"))
    rows = F.when(kind == "FeatureCollection", many).when(kind == "Feature", F.array(item)).otherwise(F.array(alone))
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.posexplode(rows).alias("at", "f")).select(*others, "at", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def positions(coordinates) -> Column:
    """All positions of a coordinates text, whatever its nesting: the innermost brackets."""
    c = F.col(coordinates) if isinstance(coordinates, str) else coordinates
    inner = F.regexp_extract_all(c, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    return F.transform(inner, lambda p: F.transform(F.filter(F.split(p, ","), lambda n: F.trim(n) != ""), lambda n: n.try_cast("double")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return geojson_features(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()))


CHUNK = "tile struct<z: int, x: int, y: int>, bounds struct<west: double, south: double, east: double, north: double>, extraction_bounds struct<west: double, south: double, east: double, north: double>, buffer_meters double"


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks below ``root``: folders with a meta.json; extraction bounds default to the bounds, the buffer to 0."""
    meta = spark.read.schema(CHUNK).option("multiLine", True).json(f"{root}/*/meta.json").withColumn("dir", F.regexp_extract(F.input_file_name(), r"([^/]+)/meta\.json$", 1))
    return meta.select("dir", "tile.*", "bounds", F.coalesce("extraction_bounds", "bounds").alias("extraction"), F.coalesce("buffer_meters", F.lit(0.0)).alias("buffer_meters"))


def read_chunk_layers(spark: SparkSession, root: str) -> DataFrame:
    """A row for each chunk and layer: chunks as of ``read_chunks`` with ``layer`` and ``path`` of each ``layer.geojson`` in their folder, by (z, x, y, dir, layer). The listing reads no file; folders without a meta.json are left out."""
    listed = read_artifacts(spark, root, "*.geojson").select("path", F.regexp_extract("path", r"([^/]+)/([^/]+)\.geojson$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.geojson$", 2).alias("layer"))
    return read_chunks(spark, root).join(listed, "dir").orderBy("z", "x", "y", "dir", "layer")


def small_files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(path, value) of the files below ``folder`` whose names end so, with their texts; names that begin with a dot or an underscore are left out.

    Tasks list and read them: one lists the folder itself, then its folders are dealt out, and the files. So neither their names nor a
    task for every few of them come to the driver, however many they are.
    """
    at, rows = uri(folder), 1000

    def listed(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, _ = fs.FileSystem.from_uri(at)
            for b in batches:
                for path, down in zip(*(c.to_pylist() for c in b.columns)):
                    if not down:
                        yield pa.RecordBatch.from_pydict({"path": [path], "down": [False]})
                        continue
                    found = store.get_file_info(fs.FileSelector(path, recursive=deep))
                    kept = [f for f in found if not f.base_name.startswith((".", "_")) and (f.base_name.endswith(ending) if f.is_file else not deep)]
                    for k in range(0, len(kept), rows):
                        yield pa.RecordBatch.from_pydict({"path": [f.path for f in kept[k : k + rows]], "down": [not f.is_file for f in kept[k : k + rows]]})

        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(at)
        for b in batches:
            for k in range(0, b.num_rows, rows):
                paths, texts = b.column(0).slice(k, rows).to_pylist(), []
                for path in paths:
                    with store.open_input_stream(path) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pydict({"path": [at.rstrip("/") + p[len(base.rstrip("/")) :] for p in paths], "value": texts})

    from pyarrow import fs

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    top = spark.createDataFrame([(fs.FileSystem.from_uri(at)[1], True)], "path string, down boolean").coalesce(1).mapInArrow(listed(False), "path string, down boolean")
    below = top.repartition(tasks, "path").mapInArrow(listed(True), "path string, down boolean")
    return below.select("path").repartition(tasks, "path").mapInArrow(read, "path string, value string")


def read_manifest(spark: SparkSession, folder: str, cache: str | None = None) -> DataFrame:
    """Image manifest (path, bounds): each X.meta.json (min, max) in ``folder`` or below describes image X. A ``cache`` table is written at the first reading and read from then on."""
    if cache is not None:
        try:
            return spark.read.schema("path string, bounds struct<west: double, south: double, east: double, north: double>").parquet(cache)
        except AnalysisException:
            read_manifest(spark, folder).write.parquet(cache)
            return read_manifest(spark, folder, cache)
    lines = small_files(spark, folder, ".meta.json").select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.explode(F.split("value", "\r\n|\r|\n")).alias("line"))
    raw = lines.filter(F.trim("line") != "").select("path", F.from_json("line", "min array<double>, max array<double>").alias("f")).select("path", "f.*")
    return raw.select("path", F.struct(F.col("min")[0].alias("west"), F.col("min")[1].alias("south"), F.col("max")[0].alias("east"), F.col("max")[1].alias("north")).alias("bounds"))


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Pixel table (tile_id, band, row_no, col_no, dn) of raster bands, values as signed 16-bit numbers."""
    from ..operators.raster import as_i16

    return spark.read.schema("tile_id int, band int, row_no int, col_no int, dn int").parquet(path).withColumn("dn", as_i16("dn"))


def list_tiles(listing: DataFrame) -> DataFrame:
    """(z, x, y, path) of paths ``z/x/y.mvt``; a part that is no number fails the job."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.mvt$", k)
    number = lambda k: F.when(part(k).rlike(r"^\d+$"), part(k).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a tile path: "), "path")).cast("int"))
    return listing.filter(F.col("path").endswith(".mvt")).select(number(1).alias("z"), number(2).alias("x"), number(3).alias("y"), "path")
