"""SQL of the image queries: bilinear samples, blends and projections written out for any engine."""

from __future__ import annotations

from .q_spatial import LAT, X, Y

MANIFEST = "SELECT tile_id, 'img-' || lpad(CAST(tile_id AS VARCHAR(9)), 6, '0') AS path, (tile_id % 4) * 9e0 AS west, (tile_id - tile_id % 4) * 2e0 AS south, (tile_id % 4) * 9e0 + 10e0 AS east, (tile_id - tile_id % 4) * 2e0 + 10e0 AS north FROM (SELECT DISTINCT tile_id FROM dx_px) t"
_EAST = "((floor(tile_id / 36e0) + 4) % 8 - 4) * 37e0"
_NORTH = "(-floor(tile_id / 4e0) * 8e0 + floor(tile_id % 36 / 4e0) * 8e0 + floor(floor(tile_id / 36e0) / 8e0) % 50 * 1e-1)"
BANDED = f"SELECT tile_id, path, west + {_EAST} AS west, south + {_NORTH} AS south, east + {_EAST} AS east, north + {_NORTH} AS north FROM ({MANIFEST}) m"


def sampled(positions: str, keys: str, px: str = "dx_px", edge: int = 23) -> str:
    """Bilinear r, g, b, a at (tile_id, fx, fy) of square images whose last pixel is ``edge``; ``keys`` pass through."""
    mix = lambda c: f"(p00.{c} * (1 - u) + p01.{c} * u) * (1 - v) + (p10.{c} * (1 - u) + p11.{c} * u) * v AS {c}"
    corner = lambda n, y, x: f"JOIN {px} {n} ON {n}.tile_id = q.tile_id AND {n}.row_no = {y} AND {n}.col_no = {x}"
    return f"""SELECT {keys}, {', '.join(map(mix, 'rgba'))} FROM (SELECT *, fx - c0 AS u, fy - r0 AS v, least(c0 + 1, {edge}) AS c1, least(r0 + 1, {edge}) AS r1 FROM (SELECT *, CAST(floor(fx) AS INT) AS c0, CAST(floor(fy) AS INT) AS r0 FROM
(SELECT * REPLACE (least(greatest(fx, 0e0), {edge}e0) AS fx, least(greatest(fy, 0e0), {edge}e0) AS fy) FROM ({positions})))) q {corner('p00', 'r0', 'c0')} {corner('p01', 'r0', 'c1')} {corner('p10', 'r1', 'c0')} {corner('p11', 'r1', 'c1')}"""


_AT = "(lon - west) / (east - west) * 24 - 0.5e0 AS fx, (north - lat) / (north - south) * 24 - 0.5e0 AS fy"
_GRID = f"""SELECT q.request, m.tile_id, m.path, q.r, q.c, {_AT} FROM (SELECT request, r, c, w + (c + 0.5e0) / 12 * (e - w) AS lon, n - (r + 0.5e0) / 10 * (n - s) AS lat, w, s, e, n
FROM (SELECT tile_id AS request, west + 4e0 AS w, south + 1e0 AS s, west + 14e0 AS e, south + 9e0 AS n FROM ({MANIFEST})), range(10) a(r), range(12) b(c)) q
JOIN ({MANIFEST}) m ON q.w < m.east AND q.e > m.west AND q.s < m.north AND q.n > m.south AND q.lon BETWEEN m.west AND m.east AND q.lat BETWEEN m.south AND m.north"""
_OVER = "{" + ", ".join(f"'{c}': CASE WHEN y.a / 255e0 + x.a / 255e0 * (1 - y.a / 255e0) > 0 THEN (y.{c} * (y.a / 255e0) + x.{c} * (x.a / 255e0 * (1 - y.a / 255e0))) / (y.a / 255e0 + x.a / 255e0 * (1 - y.a / 255e0)) ELSE 0e0 END" for c in "rgb") + ", 'a': (y.a / 255e0 + x.a / 255e0 * (1 - y.a / 255e0)) * 255e0}"
MOSAIC = f"""SELECT request, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, {', '.join(f'CAST(round(p.{c}) AS INT) AS {c}' for c in 'rgba')} FROM (SELECT request, r_ AS r, c_ AS c, list_reduce(list_prepend({{'r': 0e0, 'g': 0e0, 'b': 0e0, 'a': 0e0}}, l), lambda x, y: {_OVER}) AS p FROM
(SELECT request, r_, c_, list({{'r': r, 'g': g, 'b': b, 'a': a}} ORDER BY path) AS l FROM ({sampled(_GRID.replace('q.r, q.c,', 'q.r AS r_, q.c AS c_,'), 'q.request, q.path, q.r_, q.c_')}) GROUP BY ALL))"""

_PIXELS = f"""SELECT x, y, r AS r_, c AS c_, tile_id, path, {_AT} FROM (SELECT *, (x + (c + 0.5e0) / 16) / 32e0 * 360e0 - 180e0 AS lon, degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + (r + 0.5e0) / 16) / 32e0)))) AS lat FROM (SELECT *, unnest(range({Y('north', 5)}, {Y('south', 5)} + 1)) AS y FROM (SELECT *, unnest(range({X('west', 5)}, {X('east', 5)} + 1)) AS x FROM ({BANDED}))), range(16) a(r), range(16) b(c))
WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north"""
MERCATOR = f"""SELECT 5 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(r_ AS INT) AS row_no, CAST(c_ AS INT) AS col_no, {', '.join(f'CAST(round(arg_max({c}, path)) AS INT) AS {c}' for c in 'rgba')} FROM ({sampled(_PIXELS, 'q.x, q.y, q.r_, q.c_, q.path')}) GROUP BY x, y, r_, c_"""

# The ellipsoid and the third flattening of WGS 84.
_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_RADIUS = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_SERIES = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * _N**0.5 / (1 + _N)


def utm(lon: str, lat: str, meridian: str) -> tuple[str, str]:
    """(easting, northing) of a position, as SQL."""
    number = lambda v: f"{v:.17e}"
    t = f"sinh(atanh(sin(radians({lat}))) - {number(_E)} * atanh({number(_E)} * sin(radians({lat}))))"
    lam = f"radians({lon} - ({meridian}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join(f"{number(c)} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(_SERIES, 1))
    north = " + ".join(f"{number(c)} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(_SERIES, 1))
    return f"(500000e0 + {number(_RADIUS)} * ({eta} + {east}))", f"({number(_RADIUS)} * ({xi} + {north}))"


_AWAY = utm("lon", "lat", "3e0 + west")
_CORNER = utm("west", "north", "3e0 + west")
UTM = f"""SELECT q.tile_id, q.row_no, q.col_no, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, CASE WHEN q.sr >= 23 OR q.sc >= 23 OR p.a IS NULL THEN 0 ELSE p.a END AS a
FROM (SELECT tile_id, row_no, col_no, CAST(round_even(({_AWAY[0]} - {_CORNER[0]}) / 50000e0, 0) AS INT) AS sc, CAST(round_even(({_CORNER[1]} - {_AWAY[1]}) / 50000e0, 0) AS INT) AS sr
FROM (SELECT *, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, west + (c + 0.5e0) / 24 * (east - west) AS lon, north - (r + 0.5e0) / 24 * (north - south) AS lat FROM ({BANDED}), range(24) a(r), range(24) b(c))) q
LEFT JOIN dx_px p ON p.tile_id = q.tile_id AND p.row_no = q.sr AND p.col_no = q.sc"""

COMPONENTS = """WITH RECURSIVE c AS (SELECT tile_id, row_no, col_no FROM dx_bands WHERE band = 0 AND (row_no * 7 + col_no * 5 + tile_id) % 3 <> 0),
d AS (SELECT 0 AS dr, 1 AS dc UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0),
r AS (SELECT tile_id, row_no, col_no, row_no AS rr, col_no AS rc FROM c UNION SELECT n.tile_id, n.row_no, n.col_no, r.rr, r.rc FROM r CROSS JOIN d JOIN c n ON n.tile_id = r.tile_id AND n.row_no = r.row_no + d.dr AND n.col_no = r.col_no + d.dc)
SELECT tile_id, row_no, col_no, min(CAST(rr AS BIGINT) * (SELECT max(col_no) + 1 FROM c) + rc) AS label FROM r GROUP BY 1, 2, 3"""

HILBERT = f"""WITH RECURSIVE t AS (SELECT DISTINCT x, y FROM (SELECT *, unnest(range({Y('north', 12)}, {Y('south', 12)} + 1)) AS y FROM (SELECT *, unnest(range({X('west', 12)}, {X('east', 12)} + 1)) AS x FROM fx_boxes))),
h AS (SELECT x AS ox, y AS oy, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(0 AS BIGINT) AS d, CAST(2048 AS BIGINT) AS n FROM t UNION ALL
SELECT ox, oy, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN n - 1 - y ELSE y END, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN n - 1 - x ELSE x END, d + n * n * CASE WHEN ry = 1 THEN CASE WHEN rx = 1 THEN 2 ELSE 1 END ELSE 3 * rx END, n // 2
FROM (SELECT ox, oy, x % n AS x, y % n AS y, x // n AS rx, y // n AS ry, d, n FROM h WHERE n > 0))
SELECT CAST(ox AS INT) AS x, CAST(oy AS INT) AS y, d + 5592405 AS hilbert_id FROM h WHERE n = 0"""

TILEJSON = f"""SELECT '{{"tilejson":"3.0.0","name":"mosaic","scheme":"xyz","minzoom":5,"maxzoom":5,"bounds":[' || array_to_string([CAST(round(min(x) / 32e0 * 360 - 180, 6) AS VARCHAR), CAST(round(greatest({LAT('max(y) + 1', 5)}, -85.05112878e0), 6) AS VARCHAR), CAST(round((max(x) + 1) / 32e0 * 360 - 180, 6) AS VARCHAR), CAST(round(least({LAT('min(y)', 5)}, 85.05112878e0), 6) AS VARCHAR)], ',') || ']}}' AS json
FROM (SELECT CAST(tile_id % 4 AS INT) AS x, CAST(tile_id // 4 AS INT) AS y FROM dx_px)"""


def _level(k: int, images: str, px: str, side: int, size: int = 16) -> str:
    """CTEs of the tiles, pixels and images of level ``k`` of the quadtree, sampled from ``images`` of ``side`` pixels."""
    w, h = 360 / 2**k, 180 / 2**k
    bit = lambda t, i: f"({t} // {1 << (k - i)} % 2)"
    key = " || '_' || ".join(f"CASE WHEN {bit('tile_y', i)} = 1 THEN 'T' ELSE 'B' END || CASE WHEN {bit('tile_x', i)} = 1 THEN 'R' ELSE 'L' END" for i in range(1, k + 1)) or "'R'"
    steps = lambda lo, hi, o, s: f"range(greatest(CAST(floor(({lo} + {o}) / {s}e0) AS BIGINT), 0), least(CAST(ceil(({hi} + {o}) / {s}e0) AS BIGINT), {2**k}))"
    at = f"(lon - m.west) / (m.east - m.west) * {side} - 0.5e0 AS fx, (m.north - lat) / (m.north - m.south) * {side} - 0.5e0 AS fy"
    grid = f"""SELECT q.key AS key_, q.r AS r_, q.c AS c_, m.tile_id, m.path, {at} FROM (SELECT *, west + (c + 0.5e0) / {size} * (east - west) AS lon, north - (r + 0.5e0) / {size} * (north - south) AS lat FROM t{k}, range({size}) a(r), range({size}) b(c)) q
JOIN {images} m ON q.west < m.east AND q.east > m.west AND q.south < m.north AND q.north > m.south AND lon BETWEEN m.west AND m.east AND lat BETWEEN m.south AND m.north"""
    blend = f"""SELECT key_, r_, c_, {', '.join(f'CAST(round(p.{c}) AS INT) AS {c}' for c in 'rgba')} FROM (SELECT key_, r_, c_, list_reduce(list_prepend({{'r': 0e0, 'g': 0e0, 'b': 0e0, 'a': 0e0}}, l), lambda x, y: {_OVER}) AS p FROM
(SELECT key_, r_, c_, list({{'r': r, 'g': g, 'b': b, 'a': a}} ORDER BY path) AS l FROM ({sampled(grid, 'q.key_, q.path, q.r_, q.c_', px, side - 1)}) GROUP BY ALL))"""
    return f"""t{k} AS MATERIALIZED (SELECT *, {key} AS key, tile_x * {w}e0 - 180e0 AS west, tile_y * {h}e0 - 90e0 AS south, tile_x * {w}e0 - 180e0 + {w}e0 AS east, tile_y * {h}e0 - 90e0 + {h}e0 AS north
FROM (SELECT DISTINCT tile_x, tile_y FROM (SELECT tile_x, unnest({steps('south', 'north', 90, h)}) AS tile_y FROM (SELECT *, unnest({steps('west', 'east', 180, w)}) AS tile_x FROM {images})))),
p{k} AS MATERIALIZED (SELECT {k} AS level, t.key, t.key AS tile_id, t.tile_x, t.tile_y, CAST(a.r AS INT) AS row_no, CAST(b.c AS INT) AS col_no, {', '.join(f'coalesce(g.{c}, 0) AS {c}' for c in 'rgba')} FROM t{k} t CROSS JOIN range({size}) a(r) CROSS JOIN range({size}) b(c) LEFT JOIN ({blend}) g ON g.key_ = t.key AND g.r_ = a.r AND g.c_ = b.c),
i{k} AS MATERIALIZED (SELECT key AS tile_id, key AS path, west, south, east, north FROM t{k})"""


QUADTREE = f"WITH i3 AS (SELECT * FROM ({BANDED}) x), {_level(2, 'i3', 'dx_px', 24)}, {_level(1, 'i2', 'p2', 16)}, {_level(0, 'i1', 'p1', 16)} " + " UNION ALL ".join(f"SELECT level, key, tile_x, tile_y, row_no, col_no, r, g, b, a FROM p{k}" for k in (2, 1, 0))

RESAMPLED = f"""WITH g AS MATERIALIZED (SELECT CAST(tile_id % 2 * 24 + col_no AS BIGINT) AS gx, CAST(tile_id // 2 * 24 + row_no AS BIGINT) AS gy, r, g, b FROM dx_px),
w AS (SELECT tile_id AS request, tile_id % 2 * 24e0 + 15.25e0 AS west, tile_id // 2 * -24e0 - 29.5e0 AS south, tile_id % 2 * 24e0 + 33e0 AS east, tile_id // 2 * -24e0 - 11.75e0 AS north, 24 * (SELECT max(tile_id // 2) + 1 FROM dx_px) AS down FROM (SELECT DISTINCT tile_id FROM dx_px)),
f AS (SELECT request, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, least(greatest(west + (east - west) * ((c + 0.5e0) / 11) - 0.5e0, greatest(floor(west), 0)), least(floor(east) + 1, 47)) AS fx,
least(greatest(-(south + (north - south) * ((9 - r - 1 + 0.5e0) / 9)) - 0.5e0, greatest(floor(-north), 0)), least(floor(-south) + 1, down - 1)) AS fy FROM w, range(9) a(r), range(11) b(c)),
q AS (SELECT *, CAST(floor(fx) AS BIGINT) AS x, CAST(floor(fy) AS BIGINT) AS y, fx - floor(fx) AS u, fy - floor(fy) AS v FROM f)
SELECT request, row_no, col_no, {", ".join(f"CAST(round((p.{c} * (1 - u) + coalesce(p01.{c}, p.{c}) * u) * (1 - v) + (coalesce(p10.{c}, p.{c}) * (1 - u) + coalesce(CASE WHEN p10.gx IS NULL THEN p01.{c} ELSE coalesce(p11.{c}, p10.{c}) END, p.{c}) * u) * v) AS INT) AS {c}" for c in "rgb")}
FROM q JOIN g p ON p.gx = x AND p.gy = y LEFT JOIN g p01 ON p01.gx = x + 1 AND p01.gy = y LEFT JOIN g p10 ON p10.gx = x AND p10.gy = y + 1 LEFT JOIN g p11 ON p11.gx = x + 1 AND p11.gy = y + 1"""
