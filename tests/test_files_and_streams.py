"""Pyramids, windows, components, files and streams by literal cases and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import spatial as S
from tramline.operators import fields, gtfs_import, raster, rolling
from tramline.plans import q_io
from tramline.plans.q_io import conf
from tramline.sources import readers, sinks
from tramline.steps import save

PX = "tile_id string, row_no int, col_no int, r int, g int, b int, a int"


def image(name, size, colour):
    return [(name, y, x, *colour(x, y), 255) for y in range(size) for x in range(size)]


def images(spark, rows):
    return spark.createDataFrame(rows, "tile_id string, west double, south double, east double, north double, width int, height int").select("tile_id", F.col("tile_id").alias("path"), S.box("west", "south", "east", "north").alias("bounds"), "width", "height")


# -- quadtree pyramid ----------------------------------------------------------------------------


def test_quad_pyramid_levels_keys_and_resume(spark, tmp_path):
    px = spark.createDataFrame(image("a", 8, lambda x, y: (10 * x, 20 * y, 5)) + image("b", 8, lambda x, y: (200, 0, 0)), PX)
    manifest = images(spark, [("a", -180.0, 0.0, -90.0, 90.0, 8, 8), ("b", 90.0, -90.0, 180.0, -45.0, 8, 8)])
    path = str(tmp_path / "pyramid")
    got = raster.quad_pyramid(px, manifest, 8, 2, path)
    keys = {(r.level, r.key) for r in got.select("level", "key").distinct().collect()}
    # a fills the four tiles of its quarter's western half; b is one tile of the south-east.
    assert keys == {(2, "TL_BL"), (2, "TL_TL"), (2, "BR_BR"), (1, "TL"), (1, "BR"), (0, "R")}
    at = {(r.level, r.key, r.row_no, r.col_no): (r.r, r.g, r.b, r.a) for r in got.collect()}
    assert at[2, "BR_BR", 3, 3] == (200, 0, 0, 255) and at[0, "R", 7, 7] == (200, 0, 0, 255)
    assert at[1, "BR", 0, 0] == (0, 0, 0, 0) and at[0, "R", 0, 7] == (0, 0, 0, 0)
    assert len(at) == 6 * 64
    # The lower half of the image, 4 of its rows in 8: positions are a quarter pixel off.
    assert at[2, "TL_BL", 0, 0] == (0, round(20 * 3.75), 5, 255)
    # A pyramid that lost its upper levels is completed from what is there; what is there is not made again.
    import shutil

    shutil.rmtree(f"{path}/level=0")
    files = {p.name for p in (tmp_path / "pyramid" / "level=2").iterdir()}
    spark.read.parquet(f"{path}/level=1").filter("key != 'TL'").write.parquet(f"{path}/kept")
    shutil.rmtree(f"{path}/level=1")
    shutil.move(f"{path}/kept", f"{path}/level=1")
    again = raster.quad_pyramid(px, manifest, 8, 2, path)
    assert {(r.level, r.key, r.row_no, r.col_no): (r.r, r.g, r.b, r.a) for r in again.collect()} == at
    parts = lambda names: {n for n in names if n.startswith("part-")}
    data = [n for n in parts(p.name for p in (tmp_path / "pyramid" / "level=2").iterdir()) if n not in files]
    assert not data or spark.read.parquet(*[f"{path}/level=2/{n}" for n in data]).count() == 0


def test_quad_pyramid_of_nothing(spark, tmp_path):
    assert raster.quad_pyramid(spark.createDataFrame([], PX), images(spark, []), 4, 1, str(tmp_path / "none")).count() == 0


# -- windows of a tiled image --------------------------------------------------------------------


def sampled(values, area, bounds, cols, rows):
    """By hand, on the whole image (rows of numbers)."""
    down, across = len(values), len(values[0])
    w, s, e, n = bounds
    x_of, y_of = lambda lon: (lon - w) / (e - w) * across, lambda lat: (1 - (lat - s) / (n - s)) * down
    x0, y0 = max(0, math.floor(x_of(area[0]))), max(0, math.floor(y_of(area[3])))
    x1, y1 = min(across - 1, math.floor(x_of(area[2])) + 1), min(down - 1, math.floor(y_of(area[1])) + 1)
    out = {}
    for r, c in itertools.product(range(rows), range(cols)):
        x = min(max(x_of(area[0] + (area[2] - area[0]) * (c + 0.5) / cols) - 0.5, x0), x1)
        y = min(max(y_of(area[1] + (area[3] - area[1]) * (rows - r - 0.5) / rows) - 0.5, y0), y1)
        ix, iy = int(x), int(y)
        u, v = x - ix, y - iy
        jx, jy = min(ix + 1, across - 1), min(iy + 1, down - 1)
        out[r, c] = (values[iy][ix] * (1 - u) + values[iy][jx] * u) * (1 - v) + (values[jy][ix] * (1 - u) + values[jy][jx] * u) * v
    return out


def test_windows_cross_tile_edges(spark):
    rng = random.Random(3)
    across, down = 2 * 8, 3 * 4
    values = [[rng.randrange(256) for _ in range(across)] for _ in range(down)]
    px = spark.createDataFrame([(x // 8, y // 4, y % 4, x % 8, values[y][x]) for y in range(down) for x in range(across)], "tx int, ty int, row_no int, col_no int, r int")
    bounds = (-180.0, -90.0, 180.0, 90.0)
    areas = {0: (-180.0, -90.0, 180.0, 90.0), 1: (-30.0, -40.0, 40.0, 35.0), 2: (-181.0, 10.0, -170.0, 91.0), 3: (1.0, 29.0, 2.0, 31.0)}
    windows = spark.createDataFrame([(k, *a) for k, a in areas.items()], "request int, west double, south double, east double, north double").select("request", S.box("west", "south", "east", "north").alias("area"))
    got = {(r.request, r.row_no, r.col_no): r.r for r in raster.tile_resample(px, windows, bounds, 8, 4, 2, 3, 7, 5, "r").collect()}
    want = {(k, *at): v for k, a in areas.items() for at, v in sampled(values, a, bounds, 7, 5).items()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) <= 0.5 + 1e-9


# -- components ----------------------------------------------------------------------------------


def spiral(n):
    """One path of cells that winds inwards over n by n cells, with a free cell between its turns."""
    cells, (y, x), (dy, dx), left = {(0, 0)}, (0, 0), (0, 1), n - 1
    turns = 0
    while left > 0:
        for _ in range(left):
            y, x = y + dy, x + dx
            cells.add((y, x))
        dy, dx = dx, -dy
        turns += 1
        if turns >= 3 and turns % 2:
            left -= 2
    return cells


def test_spiral_in_few_rounds(spark):
    cells = spiral(140)
    assert len(cells) > 9_000
    mask = spark.createDataFrame([(1, r, c) for r, c in cells] + [(2, 0, 0), (2, 5, 5), (2, 5, 6)], "tile_id int, row_no int, col_no int")
    steps = []
    got = fields.grid_components(mask, ["tile_id"], lambda d: steps.append(d) or save(d))
    labels = {(r.tile_id, r.label): r["count"] for r in got.groupBy("tile_id", "label").count().collect()}
    assert labels == {(1, 0): len(cells), (2, 0): 1, (2, 5 * 140 + 5): 2}
    # Three steps a round: what a node becomes, the links that are left, and the way back.
    assert len(steps) < 3 * 20


@pytest.mark.parametrize("seed", range(3))
def test_components_by_search(spark, seed):
    rng = random.Random(seed)
    cells = {(k, rng.randrange(12), rng.randrange(12)) for k in (1, 2) for _ in range(80)}
    got = {(r.tile_id, r.row_no, r.col_no): r.label for r in fields.grid_components(spark.createDataFrame(list(cells), "tile_id int, row_no int, col_no int"), ["tile_id"], save).collect()}
    width = max(c for _, _, c in cells) + 1
    want = {}
    for start in sorted(cells):
        if start not in want:
            todo = [start]
            while todo:
                k, r, c = todo.pop()
                if (k, r, c) in cells and (k, r, c) not in want:
                    want[k, r, c] = start[1] * width + start[2]
                    todo += [(k, r + 1, c), (k, r - 1, c), (k, r, c + 1), (k, r, c - 1)]
    assert got == want


# -- percentiles ---------------------------------------------------------------------------------


def test_p90_by_sorting(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 1]), i, rng.randrange(4000) // 7 * 7, rng.choice([rng.random() * 30, 2000.0, -1.0, None, 0.05, 0.15])) for i in range(1500)] + [(2, 9000, None, 1.0), (None, 9001, 5, 7.0)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ms long, v double")
    got = {r.event_id: r.p90 for r in rolling.rolling_p90(d, "user_id", "ms", "v", 300).collect()}
    bucket = lambda v: min(max(math.floor(v / 0.1 + 0.5), 0), 10_000)
    assert len(got) == len(rows)
    for u, i, ms, _ in rows:
        own = sorted(bucket(v) for w, _, t, v in rows if w == u and ms is not None and t is not None and ms - 300 <= t <= ms and v is not None)
        assert got[i] is None if not own else abs(got[i] - own[math.ceil(len(own) * 0.9) - 1] * 0.1) < 1e-9


def test_histogram_ranks():
    h = rolling.Histogram()
    for b in (0, 99, 100, 10_000):
        h.add(b)
    assert [h.rank(s) for s in (0.0, 0.25, 0.5, 0.75, 1.0)] == [0, 0, 99, 100, 10_000]
    h.add(10_000, -1)
    assert h.n == 3 and h.rank(1.0) == 100


# -- schedule files ------------------------------------------------------------------------------


def test_rows_of_uneven_width_and_undecodable_cells(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "stop_times.txt").write_bytes("﻿trip_id, stop_id ,stop_sequence,arrival_time\nT1,S1,1,08:00:00\nT1,S2\nT1,S3,3,9:00:00,more,cells\nT1,S4,four,25:10:00\nT1,\xd6,5,\n".encode("utf-8") + b"T1,S\xff6,6,10:00\nT1,S7,40000,x:y\n")
    raw = readers.read_gtfs(spark, str(tmp_path / "a"))
    good, bad = gtfs_import.sorted_out(raw, gtfs_import.SPECS["stop_times"])
    typed = gtfs_import.load(good, gtfs_import.SPECS["stop_times"], 1, strict=True).select("stop_gtfs_id", "stop_sequence", "arrival_time").collect()
    assert sorted(map(tuple, typed), key=lambda r: r[0]) == [("S1", 1, 28800), ("S2", None, None), ("S3", 3, 32400), ("\xd6", 5, None)]
    faults = sorted((r.file, r.column, r.value) for r in bad.collect())
    assert faults == [("stop_times.txt", "arrival_time", "10:00"), ("stop_times.txt", "arrival_time", "x:y"), ("stop_times.txt", "stop_gtfs_id", "S�6"), ("stop_times.txt", "stop_sequence", "40000"), ("stop_times.txt", "stop_sequence", "four")] or \
        faults == [("stop_times.txt", "arrival_time", "x:y"), ("stop_times.txt", "stop_gtfs_id", "S�6"), ("stop_times.txt", "stop_sequence", "40000"), ("stop_times.txt", "stop_sequence", "four")]
    with pytest.raises(Exception, match=r"not a short: four at stop_times.txt row \d+"):
        gtfs_import.load(raw.filter("stop_id = 'S4'"), gtfs_import.SPECS["stop_times"], 1, strict=True).collect()


# -- files ---------------------------------------------------------------------------------------


def test_counted_write_that_loses_rows_fails(spark, tmp_path):
    d = spark.range(100)
    assert sinks.write_counted(d, str(tmp_path / "a")) == (100, 100)
    with pytest.raises(sinks.CountMismatch, match="100 rows were produced, 90"):
        sinks.write_counted(d, str(tmp_path / "b"), F.col("id") % 10 != 0)
    assert sinks.write_counted(d.limit(0), str(tmp_path / "c")) == (0, 0)


def test_files_by_name(spark, tmp_path):
    tiles = spark.createDataFrame([("13/4/5.png", bytearray(b"\x89PNG\x00\xff")), ("13/4/6.png", None), ("a.txt", bytearray("\xe4".encode()))], "path string, content binary")
    assert sinks.write_files(tiles, f"file://{tmp_path}/out") == 3
    assert (tmp_path / "out/13/4/5.png").read_bytes() == b"\x89PNG\x00\xff" and (tmp_path / "out/13/4/6.png").read_bytes() == b""
    got = {r.path.rsplit("/out/", 1)[1]: (r.length, bytes(r.content)) for r in readers.read_artifacts(spark, f"{tmp_path}/out", "*.png").collect()}
    assert got == {"13/4/5.png": (6, b"\x89PNG\x00\xff")}
    with pytest.raises(Exception, match="not a path below the root"):
        sinks.write_files(spark.createDataFrame([("../x", bytearray(b""))], "path string, content binary"), str(tmp_path / "out"))


def test_artifact_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"abc")
    plan = readers.read_artifacts(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


# -- streams -------------------------------------------------------------------------------------


def test_revisions_in_any_order(spark, tmp_path):
    from tramline.streaming import rolling_stream, revisions

    rng = random.Random(9)
    asked = [(t, rng.randrange(6)) for t in range(12) for _ in range(3)]
    results = [(t, rng.randrange(6), s, rng.random() < 0.7, rng.choice(["", f"p{s}"])) for s, t in enumerate(rng.choices(range(14), k=150))]
    rows = [(t, r, 0, None, None) for t, r in asked] + results
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], revisions.IN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(revisions.IN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with conf(spark, rolling_stream.STORE):
        q = revisions.latest_revisions(stream).writeStream.foreachBatch(lambda b, n: out.append(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) == 5
    shown = {r.tile: r.payload for batch in out for r in batch}
    batch = rolling.latest_revision(spark.createDataFrame(results, "tile long, revision long, seq long, ok boolean, payload string"), spark.createDataFrame(asked, "tile long, revision long"), "tile")
    assert shown == {r.tile: r.payload for r in batch.collect()}


def test_sync_that_fails_midway_gives_the_tables_of_import_version(spark, sf):
    whole, broken = q_io.feed_sync(spark, sf), q_io.feed_sync(spark, sf, "stop_times")
    assert broken.committed() == whole.committed() == [0, 1]
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(broken.versions()) == rows(whole.versions()) and rows(broken.pointers()) == rows(whole.pointers())
    for t in ("trips", "stop_times", "stop_times_seq", "stop_route_refs"):
        assert rows(broken.read(t)) == rows(whole.read(t))
    version = whole.versions().filter("status = 'active'").orderBy("id").first()
    raw = {t: q_io.run(spark, sf, sql).filter(F.col("content_hash") == version.content_hash) for t, sql in q_io.FEEDS.items()}
    alone = gtfs_import.import_version(raw, version.id)
    for t in ("agency", "stops", "routes", "trips", "stop_times", "stop_times_seq", "stop_route_refs", "stop_route_agg"):
        columns = alone[t].columns
        assert rows(whole.read(t).filter(F.col("version_id") == version.id).select(columns)) == rows(alone[t])


def test_a_committed_batch_is_not_run_again(spark, sf, tmp_path):
    from tramline.streaming import ingest

    store = ingest.VersionStore(spark, str(tmp_path / "store"))
    store.commit(4)
    ingest.sync_batch(store, 4, None, None, None)
    assert store.committed() == [4]
    with pytest.raises(ValueError, match="no batch"):
        ingest.VersionStore(spark, str(tmp_path / "other")).read("stops")
