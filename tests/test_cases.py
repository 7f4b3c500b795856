"""Literal cases: tile arithmetic, quadtree, edges, images, streams against batch, and empty inputs."""

import json
import math
import os
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import spatial as S
from tramline.operators import discovery, fields, gtfs_import, raster, roads, rolling, shapes, tiling, transit, versions

from tramline.steps import save

from .conftest import SF


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bounds_and_tiles(spark):
    d = spark.createDataFrame([(13.36, 52.49, 13.46, 52.535)], "w double, s double, e double, n double")
    got = {(r.x, r.y) for r in S.tiles_for_bounds(d, "w", "s", "e", "n", 13).collect()}
    assert got == {(4400, 2686), (4400, 2687), (4401, 2686), (4401, 2687), (4402, 2686), (4402, 2687)}
    r = one(spark, S.parse_bounds(F.lit("13.36,52.49,13.46,52.535"))["valid"], S.parse_bounds(F.lit("13.46,52.49,13.36,52.535"))["valid"], S.parse_bounds(F.lit("a,b"))["valid"])
    assert list(r) == [True, False, False]


def test_touching_boxes(spark):
    a, b = S.box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), S.box(*map(F.lit, (1.0, 0.0, 2.0, 1.0)))
    assert list(one(spark, S.intersects(a, b), S.intersects(a, b, True))) == [False, True]


def test_chunk_targets(spark):
    c = spark.createDataFrame([(13, 4400, 2686)], "z int, x int, y int")
    assert [(r.tx, r.ty) for r in roads.target_tiles(c, 12).collect()] == [(2200, 1343)]
    assert {(r.tx, r.ty) for r in roads.target_tiles(c, 14).collect()} == {(8800, 5372), (8800, 5373), (8801, 5372), (8801, 5373)}


def test_quadtree(spark):
    area = (-10.0, 5.0, -5.0, 10.0)
    area = (-10.0, 5.0, 10.0, 10.0)
    assert list(one(spark, S.quad_bbox(F.array(F.lit("TR"), F.lit("BL")), area).alias("b")).b) == [0.0, 7.5, 5.0, 8.75]
    d = spark.createDataFrame([(0.0, 7.5, 5.0, 8.75), (0.0, 8.7, 5.0, 8.75)], "a double, b double, c double, d double")
    got = S.quad_cover(d, "a", "b", "c", "d", area, 2)
    assert {r.key for r in got.collect()} == {"TR_BL"}
    assert {r.key for r in S.quad_cover(d.limit(1), "a", "b", "c", "d", area, 3).collect()} == {"TR_BL_BL", "TR_BL_BR", "TR_BL_TL", "TR_BL_TR"}


def test_mercator(spark):
    r = one(spark, S.mercator(F.lit(0.0), F.lit(0.0)).alias("m"), S.meters_unit(F.lit(0.5)).alias("u"), S.mercator_to_lnglat(F.lit(0.5), F.lit(0.5), F.lit(0.02)).alias("l"))
    assert abs(r.m.x - 0.5) < 1e-12 and abs(r.m.y - 0.5) < 1e-12
    assert abs(r.l.altitude - 0.02 * S.EARTH_CIRCUMFERENCE) < 1e-6


def test_edge_distance_is_brute_force(spark):
    rng = np.random.default_rng(3)
    edges = rng.random((5, 4))
    d = spark.createDataFrame([(0, *map(float, e)) for e in edges], "tile_id int, ax double, ay double, bx double, by double")
    got = {(r.row_no, r.col_no): r.value for r in fields.edge_distance(d, 16, 12, 0.15).collect()}
    assert len(got) == 192
    for (row, col), v in got.items():
        p = np.array([(col + 0.5) / 16, (row + 0.5) / 12])
        best = min(np.linalg.norm(p - (a + (b - a) * np.clip(np.dot(p - a, b - a) / np.dot(b - a, b - a), 0, 1))) for a, b in ((e[:2], e[2:]) for e in edges))
        assert abs(v - min(best, 0.15) / 0.15) < 1e-9
    none = spark.createDataFrame([(1, None, None, None, None)], d.schema)
    assert {r.value for r in fields.edge_distance(none, 4, 4, 0.15).collect()} == {0.0}


def test_grid_components_are_flood_fill(spark):


    rng = np.random.default_rng(5)
    mask = rng.random((12, 12)) < 0.6
    cells = [(0, int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    got = {(r.row_no, r.col_no): r.label for r in fields.grid_components(spark.createDataFrame(cells, "tile_id int, row_no int, col_no int"), ["tile_id"], save).collect()}
    seen, want = set(), {}
    for _, r, c in cells:
        if (r, c) in seen:
            continue
        stack, part = [(r, c)], []
        seen.add((r, c))
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= n[0] < 12 and 0 <= n[1] < 12 and mask[n] and n not in seen:
                    seen.add(n)
                    stack.append(n)
        for p in part:
            want[p] = frozenset(part)
    assert set(got) == set(want)
    by = {}
    for p, label in got.items():
        by.setdefault(label, set()).add(p)
    assert all(frozenset(by[got[p]]) == part for p, part in want.items())


def test_mosaic_of_quadrants(spark):
    px = spark.createDataFrame([(t, r, c, 10 * t, 0, 0, 255) for t in range(4) for r in range(4) for c in range(4)], "tile_id int, row_no int, col_no int, r int, g int, b int, a int")
    boxes = [(-4.0, 0.0), (0.0, 0.0), (-4.0, -4.0), (0.0, -4.0)]
    m = spark.createDataFrame([(t, f"p{t}", (w, s, w + 4, s + 4), 4, 4) for t, (w, s) in enumerate(boxes)], "tile_id int, path string, bounds struct<west: double, south: double, east: double, north: double>, width int, height int")
    req = spark.createDataFrame([(0, (-4.0, -4.0, 4.0, 4.0))], "request int, area struct<west: double, south: double, east: double, north: double>")
    got = {(r.row_no, r.col_no): r.r for r in raster.mosaic(px, m, req, 8, 8).collect()}
    assert len(got) == 64 and got[0, 0] == 0 and got[0, 7] == 10 and got[7, 0] == 20 and got[7, 7] == 30


def test_utm_forward_meets_known_position(spark):
    # 9 E on the equator is the central meridian of zone 32; one degree east is 111 km times the scale.
    r = one(spark, raster.utm_forward(F.lit(9.0), F.lit(0.0), F.lit(9.0)).alias("a"), raster.utm_forward(F.lit(10.0), F.lit(0.0), F.lit(9.0)).alias("b"), raster.utm_forward(F.lit(9.0), F.lit(48.0), F.lit(9.0)).alias("c"))
    assert abs(r.a.easting - 500_000) < 1e-6 and abs(r.a.northing) < 1e-6
    assert abs(r.b.easting - 611_280.6) < 10
    assert abs(r.c.northing - 5_316_300.8) < 20


def test_polyline(spark):
    # The published example at precision 5.
    d = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@")], "leg int, shape string")
    got = [(r.lat, r.lon) for r in shapes.polyline_points(d, ["leg"], 5).orderBy("point").collect()]
    assert np.allclose(got, [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)])


def test_merge_keeps_first_url_then_last_slug(spark):
    rows = [("a", "u1", 0, 0), ("b", "u1 ", 0, 1), ("a", "u2", 1, 0), ("c", "u3", 1, 1)]
    d = spark.createDataFrame(rows, "slug string, direct_download_url string, source_rank int, ordinal int").withColumns({c: F.lit(None).cast("string") for c in ("name", "source_url", "license_url", "attribution")})
    assert sorted((r.slug, r.direct_download_url) for r in discovery.merge_sources(d).collect()) == [("a", "u2"), ("c", "u3")]


def test_promote_ties_and_stale(spark):
    sources = spark.createDataFrame([(1, "s", 10), (2, "t", 20)], "id long, slug string, active_version_id int")
    v = spark.createDataFrame([(10, 1, "active", 5), (11, 1, "imported", 5), (20, 2, "active", 9), (21, 2, "imported", 8)], "id int, source_id long, status string, fetched_at int").withColumn("content_hash", F.lit(""))
    _, after, outcomes = versions.promote(sources, v, v.filter("id in (11, 21)"))
    assert {r.id: r.outcome for r in outcomes.collect()} == {11: "promoted", 21: "stale"}
    assert {r.id: r.status for r in after.collect()} == {10: "imported", 11: "active", 20: "active", 21: "imported"}


def test_import_version_keeps_dangling_ids(spark):
    text = lambda rows, *names: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_ord long, " + ", ".join(f"{n} string" for n in names))
    raw = {
        "agency": text([("", "A")], "agency_id", "agency_name"),
        "stops": text([("s1", "s9", "1.5"), ("s2", "", "x")], "stop_id", "parent_station", "stop_lat"),
        "routes": text([("r1", "")], "route_id", "agency_id"),
        "trips": text([("t1", "r1", "c")], "trip_id", "route_id", "service_id"),
        "stop_times": text([("t1", "s1", "1", "25:01:00"), ("t1", "s2", "0", "")], "trip_id", "stop_id", "stop_sequence", "arrival_time"),
    }
    out = gtfs_import.import_version(raw, 1)
    stops = {r.gtfs_id: r for r in out["stops"].collect()}
    assert stops["s1"].item_id == 2 and stops["s1"].parent_item_id == 3 and stops["s2"].item_id == 4 and stops["s2"].stop_lat is None
    seq = out["stop_times_seq"].first()
    assert seq.stop_item_ids == [4, 2] and seq.arrival_times == [None, 90060] and seq.timepoints == [1, 1]
    assert sorted((r.stop_item_id, r.route_item_ids) for r in out["stop_route_agg"].collect()) == [(2, [5]), (4, [5])]


@pytest.mark.parametrize("name,rows,column", [("stop_times", [("t", "40000")], "stop_sequence"), ("shapes", [("h", "3000000000")], "shape_pt_sequence"), ("stop_times", [("t", "700000:00:00")], "arrival_time")])
def test_numbers_out_of_range_fail(spark, name, rows, column):
    key = "trip_id" if name == "stop_times" else "shape_id"
    raw = spark.createDataFrame(rows, f"{key} string, {column} string")
    with pytest.raises(Exception, match="out of range"):
        gtfs_import.load(raw, gtfs_import.SPECS[name], 1).collect()
    ok = gtfs_import.load(spark.createDataFrame([("t", "7" if column != "arrival_time" else "1:00:01"), ("u", "x"), ("v", "")], raw.schema), gtfs_import.SPECS[name], 1)
    assert [r[column] for r in ok.collect()] == [7 if column != "arrival_time" else 3601, None, None]
    with pytest.raises(Exception, match="not a"):
        gtfs_import.load(spark.createDataFrame([("t", "x")], raw.schema), gtfs_import.SPECS[name], 1, strict=True).collect()


def test_tree_survives_a_cycle(spark):
    s = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1)], "version_id int, item_id int, parent_station_item_id int")
    agg = gtfs_import.stop_route_agg(s, spark.createDataFrame([], "version_id int, stop_item_id int, route_item_id int"))
    got = sorted((r.root_id, r.stop_id, r.depth) for r in transit.stop_tree(s, agg).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 0), (2, 3, 2), (3, 3, 0)]


def test_point_on_an_edge_is_in_both_tiles(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 50.0)], "version_id int, item_id int, stop_lon double, stop_lat double")
    assert {r.x for r in tiling.tile_points(p).collect()} == {4095, 4096}


def test_latest_revision_rules(spark):
    asked = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "tile string, revision int")
    results = spark.createDataFrame([("a", 1, 1, True, "old"), ("a", 2, 2, True, ""), ("b", 1, 3, True, "old"), ("b", 2, 4, False, ""), ("c", 1, 5, True, "new")], "tile string, revision int, seq int, ok boolean, payload string")
    assert {r.tile: r.payload for r in rolling.latest_revision(results, asked, "tile").collect()} == {"a": "old", "b": None, "c": "new"}


def test_stream_is_batch_over_many_batches(spark, tmp_path):
    """Out of order within the delay, tied and late samples, ten micro-batches: exactly the batch frames of what was not late."""
    from tramline.plans.q_io import conf
    from tramline.streaming import rolling_stream as R

    rng = random.Random(41)
    t0, source, out, mark = 1_700_000_000_000, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "user_id long, event_id long, ended_at timestamp, duration_ms double"
    on_time, late, seen = [], [], 0
    for batch in range(8):
        rows = []
        for _ in range(140):
            ms = t0 + batch * 60_000 + rng.randrange(-40_000, 60_000) // 500 * 500
            rows.append((rng.randrange(4) if batch < 5 else rng.randrange(2), len(on_time) + len(rows), ms, float(rng.randrange(1000))))
        late_rows = [(0, 100_000 + batch, t0 - 10_000_000, 5_000.0)] if batch > 1 else []
        on_time += rows
        late += late_rows
        both = spark.createDataFrame([(u, i, ms, v) for u, i, ms, v in rows + late_rows], "user_id long, event_id long, ms long, duration_ms double")
        both.select("user_id", "event_id", F.timestamp_millis("ms").alias("ended_at"), "duration_ms").coalesce(1).write.mode("append").parquet(source)
        stream = R.rolling_stream(spark.readStream.schema(schema).parquet(source), 120_000)
        with conf(spark, R.STORE):
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        now = spark.read.schema(R.OUT).parquet(out).count()
        assert now >= seen
        seen = now
    last = max(ms for _, _, ms, _ in on_time) - 120_000
    got = {(r.user_id, r.event_id): r for r in spark.read.schema(R.OUT).parquet(out).collect()}
    assert set(got) == {(u, i) for u, i, ms, _ in on_time if ms < last} and seen == len(got) > 600
    for (u, i), r in got.items():
        frame = lambda width: sorted(v for w, _, ms, v in on_time if w == u and r.ended_ms - width <= ms <= r.ended_ms)  # noqa: E731, B023
        assert r.rate == len(frame(1_000))
        assert r.recent_from == min((ms, j) for w, j, ms, _ in on_time if w == u and r.ended_ms - 10_000 <= ms <= r.ended_ms)[1]
        for name, width in R.WINDOWS.items():
            own = frame(width)
            assert (r[f"n_{name}"], r[f"min_{name}"], r[f"max_{name}"]) == (len(own), own[0], own[-1]) and abs(r[f"avg_{name}"] - sum(own) / len(own)) < 1e-9
            assert abs(r[f"p90_{name}"] - own[math.ceil(len(own) * 0.9) - 1]) < 1e-9


def test_deep_chain_and_cycle(spark):
    chain = [(1, k, k - 1 if k else None) for k in range(100)] + [(2, 1, 3), (2, 2, 1), (2, 3, 2)]
    s = spark.createDataFrame(chain, "version_id int, item_id int, parent_station_item_id int")
    agg = spark.createDataFrame([], "version_id int, stop_item_id int, route_item_ids array<int>")
    roots = spark.createDataFrame([(1, 0), (2, 1)], "version_id int, item_id int")
    tree = save(transit.stop_tree(s, agg, roots))
    got = {(r.version_id, r.stop_id): (r.depth, len(r.path)) for r in tree.collect()}
    assert got == {**{(1, k): (k, k + 1) for k in range(100)}, (2, 1): (0, 1), (2, 2): (1, 2), (2, 3): (2, 3)}
    nested = {r.version_id: r.json for r in transit.nest_stops(tree.filter("depth < 20")).collect()}
    assert nested[1].count('"stop":') == 20 and json.loads(nested[2])["children"][0]["children"][0]["stop"] == 3


def test_repaired_ids_go_past_taken_ones(spark):
    high = 1 << 63
    rows = [("a", 0, None), ("a", 1, high + 3), ("a", 2, high + 3), ("a", 3, None), ("a", 4, 7), ("a", 5, 7), ("a", 6, high), ("b", 0, 7), ("b", 1, 7)]
    d = spark.createDataFrame([(k, p, None if i is None else Decimal(i)) for k, p, i in rows], "layer string, place long, id decimal(20,0)")
    got = {(r.layer, r.place): int(r.new_id) for r in fields.repair_feature_ids(d, ["layer"]).collect()}
    want = {}
    for layer in "ab":
        used = set()
        for _, place, i in [r for r in rows if r[0] == layer]:
            new = i if i is not None and i not in used else high + place
            while new in used:
                new += 1
            used.add(new)
            want[layer, place] = new
    assert got == want


def test_field_types_are_those_of_the_values(spark):
    from tramline.operators.roads import infer_fields, typed

    d = spark.range(1).select(F.lit("l").alias("layer"), F.create_map(F.lit("a"), typed(F.lit("true"), "text"), F.lit("b"), typed(F.lit(True), "flag"), F.lit("c"), typed(F.lit("1.5"), "text"), F.lit("d"), typed(F.lit(1.5), "number"), F.lit("e"), typed(F.lit(None), "text")).alias("properties"))
    assert {r.key: r.type for r in infer_fields(d).collect()} == {"a": "String", "b": "Boolean", "c": "String", "d": "Number"}


def test_nearest_segments_are_those_of_all_pairs(spark):
    rng = random.Random(42)
    segs = [(g, k, *(rng.random() * 3 for _ in range(4)), 1.0) for g in range(3) for k in range((40, 2, 15)[g])]
    pts = [(g, k, rng.random() * 3, rng.random() * 3) for g in range(4) for k in range(25)] + [(0, 99, 50.0, -50.0)]
    s = spark.createDataFrame(segs, "g int, segment_id int, ax double, ay double, bx double, by double, confidence double")
    p = spark.createDataFrame(pts, "g int, point_id int, x double, y double")

    def dist(x, y, ax, ay, bx, by):
        t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0), 1)
        return (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2

    got = {}
    for r in fields._nearest(p, s, ["g"], 3, 0.1).collect():
        got.setdefault((r.g, r.point_id), set()).add(r.segment_id)
    want = {(g, k): {x[1] for x in sorted((x for x in segs if x[0] == g), key=lambda x: dist(px, py, *x[2:6]))[:3]} for g, k, px, py in pts if g < 3}
    assert got == want


def test_spatial_joins_are_by_equality(spark):
    box = "struct<west: double, south: double, east: double, north: double>"
    px = spark.createDataFrame([], "tile_id int, row_no int, col_no int, r int, g int, b int, a int")
    m = spark.createDataFrame([], f"tile_id int, path string, bounds {box}, width int, height int")
    requests = spark.createDataFrame([], f"request int, area {box}")
    tiles = spark.createDataFrame([], "z int, x int, y int")
    points, edges = spark.createDataFrame([], "p int, x double, y double"), spark.createDataFrame([], "polygon int, ax double, ay double, bx double, by double")
    for d in (raster.mosaic(px, m, requests, 8, 8), raster.to_web_mercator(px, m, tiles, 8), fields.in_polygon(points, edges, ["p"], "polygon", 0.1)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_points_in_polygons_by_ray(spark):
    rng = random.Random(43)
    rings = {k: [(rng.random() * 4 + k, rng.random() * 4) for _ in range(7)] for k in range(5)}
    edges = spark.createDataFrame([(k, *a, *b) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1])], "polygon int, ax double, ay double, bx double, by double")
    pts = [(k, rng.random() * 8, rng.random() * 4) for k in range(400)]
    got = {(r.p, r.polygon) for r in fields.in_polygon(spark.createDataFrame(pts, "p int, x double, y double"), edges, ["p"], "polygon", 0.3).collect()}
    cross = lambda x, y, a, b: (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]
    assert got == {(p, k) for p, x, y in pts for k, ring in rings.items() if sum(cross(x, y, a, b) for a, b in zip(ring, ring[1:] + ring[:1])) % 2}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "version_id int, item_id int, stop_lon double, stop_lat double")
    assert tiling.stop_points(none).count() == 0 and tiling.occupied_tiles(none, 13).count() == 0
    assert math.isclose(fields.finite_abs_mean(spark.createDataFrame([], "v double"), "v").first()[0], 0.0)


def test_every_image_is_projected(spark, tmp_path):
    from tramline.plans import q_map

    # 50 images; of those only 36 stood below 80 degrees north.
    spark.range(50 * 576).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = q_map.utm_images(spark, str(tmp_path)).groupBy("tile_id").count().collect()
    assert sorted(map(tuple, got)) == [(k, 576) for k in range(50)]


def test_images_lie_in_a_band(spark):
    from tramline.plans import q_map

    t = F.col("tile_id")
    box = S.box(t % 4 * 9.0, (t - t % 4) * 2.0, t % 4 * 9.0 + 10.0, (t - t % 4) * 2.0 + 10.0)
    m = spark.range(20_000).select(F.col("id").cast("int").alias("tile_id")).withColumn("bounds", box)
    rows = q_map._banded(m).select("tile_id", "bounds.*").collect()
    assert len(rows) == 20_000
    assert all(-180 <= r.west < r.east <= 180 and 0 <= r.south < r.north < 80 and abs(r.east - r.west - 10) < 1e-9 and abs(r.north - r.south - 10) < 1e-9 for r in rows)
    assert all((r.west, r.south) == (r.tile_id % 4 * 9.0, (r.tile_id - r.tile_id % 4) * 2.0) for r in rows if r.tile_id < 36)


def test_every_box_has_its_grid_and_count(spark, sf):
    from tramline.plans import q_map

    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert q_map.chunk_grid_all(spark, sf).select("feature_id").distinct().count() == n
    assert q_map.features_in_all_boxes(spark, sf).count() == n
