"""Queries on tables that are larger or odder than the given ones: what the sizes of the other tests do not show."""

import duckdb
import pytest

from tramline.plans import registry

from .compare import same

Q, S = registry.queries(), registry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events".split()


def tables(path, source, **sql):
    """Copies of the tables in ``source``, of which those named come from a query over them; the folder and an engine over it."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW given_{t} AS SELECT * FROM '{source}/{t}.parquet'")
        c.execute(f"COPY ({sql.get(t, f'SELECT * FROM given_{t}')}) TO '{path}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), c


def agree(name, spark, made):
    path, c = made
    want = c.execute(S[name]).df()
    same(Q[name](spark, path).toPandas(), want)
    assert len(want)


@pytest.fixture(scope="module")
def more_stops(tmp_path_factory, sf):
    """Four hundred and more suppliers: one of their stops stands at 22.5 degrees, on an edge of zooms 7 and 13."""
    grown = "SELECT s.* REPLACE (CAST(s_suppkey + k * (SELECT max(s_suppkey) + 1 FROM given_supplier) AS BIGINT) AS s_suppkey) FROM given_supplier s, range((SELECT CAST(ceil(800 / count(*)) AS BIGINT) FROM given_supplier)) r(k)"
    return tables(tmp_path_factory.mktemp("stops"), sf, supplier=grown)


@pytest.mark.parametrize("name", ("tile_sink", "chunk_children", "tileset_metadata"))
def test_a_stop_on_an_edge_is_in_one_tile(name, spark, more_stops):
    assert more_stops[1].execute("SELECT count(*) FROM supplier WHERE (s_suppkey * 37) % 400 = 325 AND s_suppkey % 23 <> 22 AND s_suppkey % 17 <> 16").fetchone()[0]
    agree(name, spark, more_stops)


def test_every_stop_is_asked_on_every_tile(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    tiles = duckdb.connect().execute(f"SELECT floor(count(*) / 576) FROM '{path}/part.parquet'").fetchone()[0]
    stops = duckdb.connect().execute(f"SELECT count(*) FROM '{path}/supplier.parquet'").fetchone()[0]
    assert tiles > 1 and Q["point_elevations"](spark, path).count() == tiles * stops


@pytest.mark.parametrize("name", ("points_in_polygons", "segments_in_polygons", "segments_of_components"))
def test_every_row_meets_every_polygon(name, spark, more_stops):
    """Polygons lie over one another, so a place is in most of 32 and more of them, not in two."""
    agree(name, spark, more_stops)
    path, c = more_stops
    key = "feature_id" if name.startswith("points") else "segment_id"
    assert c.execute(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({S[name]}) GROUP BY {key})").fetchone()[0] > 2


def test_long_shapes_are_looked_at_once(spark):
    """Whether a shape of 60,000 places has two distinct ones: minutes where all are compared with all."""
    import time

    from tramline.operators import gtfs_import, tiling

    points = spark.range(60_000).selectExpr("1 AS version_id", "1 AS shape_item_id", "CAST(id AS INT) AS shape_pt_sequence", "id / 1e4 AS shape_pt_lat", "id / 2e4 AS shape_pt_lon")
    still = points.selectExpr("1 AS version_id", "2 AS shape_item_id", "shape_pt_sequence", "5e0 AS shape_pt_lat", "6e0 AS shape_pt_lon")
    began = time.monotonic()
    assert [r[0] for r in tiling.valid_shapes(gtfs_import.shapes_seq(points.unionByName(still))).select("shape_item_id").collect()] == [1]
    assert time.monotonic() - began < 60


def test_polylines_are_decoded_in_place(spark):
    from tramline.operators import shapes

    legs = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, ""), (3, None), (4, "_p~iF"), (5, "??")], "leg int, shape string")
    d = shapes.polyline_points(legs, ["leg"], 5)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, d.collect())) == [(1, 0, 38.5, -120.2), (1, 1, 40.7, -120.95), (1, 2, 43.252, -126.453), (4, 0, 38.5, None), (5, 0, 0.0, 0.0)]


def test_boxes_of_one_place_meet_once(spark, monkeypatch):
    """Ten places with forty boxes each: places are compared, not boxes, and packs of boxes lose and repeat none."""
    from tramline.functions import spatial
    from tramline.operators import roads

    monkeypatch.setattr(roads, "PACK", 7)
    rows = [(i, 13 + i % 10 * 0.004, 52.0, 13 + i % 10 * 0.004 + 0.006, 52.3) for i in range(400)]
    f = spark.createDataFrame(rows, "feature_id long, west double, south double, east double, north double")
    b = f.select(f.feature_id.alias("box_id"), spatial.box("west", "south", "east", "north").alias("box"))
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and p[3] >= q[1])
    assert sorted((r.feature_id, r.box_id) for r in roads.features_touching(f, b, ["box_id"]).collect()) == want
    counted = {r.box_id: r.n for r in roads.count_touching(f, b, ["box_id"]).collect()}
    assert sum(counted.values()) == len(want) and len(counted) == 400
    assert roads._places_touching(f, b, 12).count() <= 100


def test_percentiles_of_blocks_that_are_cut_by_batches(spark):
    from tramline.operators import rolling

    rows = [(k if k else None, e, e * 350 if e % 9 else None, None if e % 7 == 3 else float((e * 37 + k) % 90)) for k in range(5) for e in range(40)]
    d = spark.createDataFrame(rows, "k int, e int, ms long, v double")
    want = {}
    for k, e, t, _ in rows:
        own = sorted(v for j, _, u, v in rows if j == k and u is not None and t is not None and t - 3000 <= u <= t and v is not None)
        want[k, e] = round(own[max(1, -(-len(own) * 9 // 10)) - 1], 6) if own else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = rolling.rolling_p90(d, "k", "ms", "v", 3000)
        # One Python function over all blocks of a task: a group each cost some 5 ms, whatever its size.
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.k, r.e): None if r.p90 is None else round(r.p90, 6) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_items_of_a_sync_are_not_broadcast(spark, sf):
    """There are as many trips and stops as stop times; the sizes of their packed files say little of the memory that they take on the driver."""
    assert "Broadcast" not in Q["synced_stop_times"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_ids_are_broadcast_only_where_they_are_few(spark):
    from tramline.operators import gtfs_import as G
    from tramline.steps import save

    rows = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "stop string")
    ids = save(G.id_map(spark.createDataFrame([(0, r, 0, "stop", i) for r, i in enumerate(("b", "a", "b"))], "spec_ord int, row_ord long, ref_ord int, kind string, gtfs_id string")))
    many, few = (G.translate(rows, ids, {"item_id": ("stop", "stop")}, f) for f in ((), ("stop",)))
    for d, kept in ((many, False), (few, True)):
        assert ("BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()) == kept
        assert {r.stop: r.item_id for r in d.collect()} == {"a": 2, "b": 1, "": None, None: None}


def test_rows_are_read_once_for_all_that_they_mention(spark, tmp_path):
    from tramline.operators import gtfs_import as G

    spark.createDataFrame([(1, "t2", "r", "v", ""), (2, "t1", "r", "", "h")], "row_ord long, trip_id string, route_id string, service_id string, shape_id string").coalesce(1).write.parquet(str(tmp_path / "trips"))
    trips = G.load(spark.read.parquet(str(tmp_path / "trips")), G.SPECS["trips"] | {"row_ord": ("row_ord", "long")}, 1)
    found = G.mentions({"trips": trips})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, found.collect())) == [(3, 1, 0, "trip", "t2"), (3, 1, 1, "route", "r"), (3, 1, 2, "service", "v"), (3, 2, 0, "trip", "t1"), (3, 2, 1, "route", "r"), (3, 2, 3, "shape", "h")]
    assert {(r.kind, r.gtfs_id): r.item_id for r in G.id_map(found).collect()} == {("trip", "t2"): 1, ("route", "r"): 2, ("service", "v"): 3, ("trip", "t1"): 4, ("shape", "h"): 5}


def test_trips_are_moved_once_before_they_are_packed(spark, sf):
    from tramline.plans import q_import

    plan = q_import._imported(spark, sf)["stop_times_seq"]._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(trip_item_id" in line for line in plan.splitlines()) == 1


def test_cells_are_read_once(spark):
    """A time names its parts once, not once for each comparison with a bound, and empty cells are not cast."""
    from tramline.operators import gtfs_import as G

    raw = spark.createDataFrame([("1:02:03", ""), ("", " 1 "), (" 25:00:00", None), ("1:02", "x"), ("a:b:c", "7")], "arrival_time string, pickup_type string")
    d = G.load(raw, {"at": ("arrival_time", "time"), "pickup": ("pickup_type", "pickup_type")}, 1)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("element_at") <= 3
    assert [(r["at"], r.pickup) for r in d.collect()] == [(3723, 0), (None, 1), (90000, 0), (None, 0), (None, 7)]


def test_side_cars_are_listed_by_tasks(spark, tmp_path):
    """Side-cars in a folder and in folders below it; neither are they listed on the driver, nor does each few of them take a task."""
    from tramline.sources import readers

    (tmp_path / "b" / "c").mkdir(parents=True)
    side = lambda k: '{"min":[%d,1],"max":[2,3.5]}' % k
    for k, name in enumerate(("a b%20.png", "b/x.png", "b/c/y.png")):
        (tmp_path / f"{name}.meta.json").write_text(side(k) + "\n\n")
    for name in ("b/z.png", "_no.meta.json", "b/.no.meta.json"):
        (tmp_path / name).write_text(side(9))
    (tmp_path / "odd.meta.json").write_text("{")
    d = readers.read_manifest(spark, str(tmp_path))
    assert "FileScan" not in d._jdf.queryExecution().executedPlan().toString()
    root = f"file://{tmp_path}/"
    assert sorted((r.path.removeprefix(root), *r.bounds) for r in d.collect()) == [("a b%20.png", 0.0, 1.0, 2.0, 3.5), ("b/c/y.png", 2.0, 1.0, 2.0, 3.5), ("b/x.png", 1.0, 1.0, 2.0, 3.5), ("odd", None, None, None, None)]


def _rings(spark, offsets, holes=()):
    """Unit squares (polygon: offset) with a hole in those of ``holes``."""
    square = lambda o, a, b: [(o + a, a, o + b, a), (o + b, a, o + b, b), (o + b, b, o + a, b), (o + a, b, o + a, a)]
    rows = [(p, *e) for p, o in offsets.items() for e in square(o, 0.0, 1.0) + (square(o, 0.25, 0.5) if p in holes else [])]
    return spark.createDataFrame(rows, "polygon int, ax double, ay double, bx double, by double")


def test_pairs_of_points_and_polygons_take_little_disk(spark, tmp_path):
    """Their number grows with the square of the tables: 1,638,400 pairs took 1.27 MB."""
    from tramline.operators import fields

    rings = _rings(spark, {k: k % 20 * 0.01 for k in range(400)})
    points = spark.range(4096).selectExpr("id", "0.3 + id % 16 * 0.03 AS x", "0.5 AS y")
    fields.in_polygon(points, rings, ["id"], "polygon", 0.25).write.parquet(str(tmp_path / "pairs"))
    assert duckdb.connect().execute(f"SELECT count(*), count(DISTINCT (id, polygon)) FROM '{tmp_path}/pairs/*.parquet'").fetchone() == (1_638_400, 1_638_400)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 600_000


@pytest.mark.parametrize("pack", (1, 3, 512))
def test_points_and_polygons_by_packs(spark, monkeypatch, pack):
    """Points of one place, some of them the same in all, and polygons of one shape: packs lose and repeat none."""
    from tramline.operators import fields

    monkeypatch.setattr(fields, "PACK", pack, raising=False)
    offsets = {k: k % 3 * 0.25 for k in range(30)} | {None: 0.0}
    held = lambda p, x, y: p is not None and offsets[p] <= x < offsets[p] + 1 and 0 < y <= 1 and not (p % 2 and offsets[p] + 0.25 <= x < offsets[p] + 0.5 and 0.25 < y <= 0.5)
    points = [(k if k % 11 else None, k % 7 * 0.3, k % 2 * 0.35 + 0.05) for k in range(70)]
    points += points[:20] + points[:5] + [(90, None, 0.3), (91, 0.3, None)]
    got = fields.in_polygon(spark.createDataFrame(points, "id int, x double, y double"), _rings(spark, offsets, {p for p in offsets if p and p % 2}), ["id"], "polygon", 0.25).collect()
    want = [(i, p) for i, x, y in points if x is not None and y is not None for p in offsets if held(p, x, y)]
    assert len(want) > 500 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pairs_of_segments_and_polygons_are_not_moved(spark):
    """Segments are made distinct by shape: the pairs, which grow with the square of the tables, were moved to be made distinct."""
    from tramline.operators import fields

    offsets = {k: k % 3 * 0.25 for k in range(30)}
    held = lambda p, x, y: offsets[p] <= x < offsets[p] + 1 and 0 < y <= 1
    # Ids that come several times, at one place and at others, and rows without an id or a place.
    segs = [(k % 40 if k % 11 else None, k % 7 * 0.3, k % 2 * 0.375 + 0.0625, k % 5 * 0.25, 0.5) for k in range(60)] + [(99, None, 0.5, 0.25, 0.5)]
    segs += segs[:15]
    d = fields.component_segments(spark.createDataFrame(segs, "segment_id int, ax double, ay double, bx double, by double"), _rings(spark, offsets), "polygon", 0.25)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [segment_id" in plan and not [line for line in plan.splitlines() if "Aggregate [segment_id" in line and "polygon" in line]
    want = {(i, p) for i, ax, ay, bx, by in segs for p in offsets for x, y in ((ax, ay), (bx, by), (None if ax is None else (ax + bx) / 2, (ay + by) / 2)) if x is not None and held(p, x, y)}
    got = [tuple(r) for r in d.collect()]
    assert len(got) == len(want) > 500 and set(got) == want


@pytest.mark.parametrize("block", (2, 16))
def test_first_mentions_are_found_by_one_aggregation(spark, monkeypatch, block):
    """Ids moved twice to find where they are first mentioned, and were sorted for it; rows without a number and ids of many versions among them."""
    from tramline.operators import gtfs_import as G

    monkeypatch.setattr(G, "BLOCK", block, raising=False)
    rows = [(v, k * 5 % 8, None if k % 6 == 0 else (k * 37 + (v or 0)) % 50 - 9, k % 4, ("trip", "stop")[k % 2], None if k % 13 == 0 else f"i{k * 7 % 29}") for v in (1, 2, None) for k in range(200)]
    d = spark.createDataFrame(rows, "version_id int, spec_ord int, row_ord long, ref_ord int, kind string, gtfs_id string")
    low = lambda p: (p[0], p[1] is not None, p[1] or 0, p[2])
    for v, own in ((1, d), (None, d.filter("version_id = 2").drop("version_id"))):
        if v is None:
            mine = [r[1:] for r in rows if r[0] == 2]
        else:
            mine = [r[1:] for r in rows if r[0] == 1]
        places = {}
        for spec, row, ref, kind, i in mine:
            places.setdefault((kind, i), {}).setdefault((spec, ref), []).append(row)
        first = {}
        for key, at in places.items():
            if key[1] is not None:
                first[key] = min(((s, min((x for x in found if x is not None), default=None), f) for (s, f), found in at.items()), key=low)
        all_places = sorted([*map(low, first.values()), *(low((s, r, f)) for s, r, f, _, i in mine if i is None)])
        got = [r for r in G.id_map(own).collect() if v is None or r.version_id == v]
        assert sorted(r.item_id for r in got) == [*range(1, len(all_places) + 1)]
        assert {(r.kind, r.gtfs_id): tuple(r["at"]) for r in got if r.gtfs_id is not None} == first
        assert [low(tuple(r["at"])) for r in sorted(got, key=lambda r: r.item_id)] == all_places
    plan = G._first_mentions(d.filter("gtfs_id is not null"), ["version_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and sum("Exchange hash" in line for line in plan.splitlines()) == 1
