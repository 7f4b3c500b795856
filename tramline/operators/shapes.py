"""Route shapes: encoded polylines as rows of points, legs as lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial as S


def _decoded(shapes: pd.Series, precision: int) -> list:
    """The points of each encoded text, all texts at once: values end at a character below 32, and odd ones are negative."""
    texts = [s or "" for s in shapes]
    size = np.array([len(s) for s in texts], np.int64)
    v = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 63
    leg = np.repeat(np.arange(len(texts)), size)
    start = np.ones(len(v), bool)
    start[1:] = (v[:-1] < 32) | (leg[1:] != leg[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return [[] for _ in texts]
    place = np.arange(len(v)) - np.repeat(at, np.diff(np.append(at, len(v))))
    z = np.add.reduceat(np.left_shift(v & 31, 5 * place % 64), at)
    delta, own = np.where(z % 2 == 1, -(z >> 1) - 1, z >> 1), leg[at]
    # A leg's values alternate between the axes; the sums before it are taken off.
    first = np.searchsorted(own, own)
    number = np.arange(len(own)) - first
    sums = []
    for axis in (0, 1):
        total = np.cumsum(np.where(number % 2 == axis, delta, 0))
        before = np.where(first > 0, total[first - 1], 0)
        sums.append((total - before) / float(10**precision))
    lat, lon = np.flatnonzero(number % 2 == 0), sums[1]
    # The last point of a text that ends midway has no longitude.
    paired = np.append(own[1:], -1)[lat] == own[lat]
    points = list(zip((number[lat] // 2).tolist(), sums[0][lat].tolist(), [x if ok else None for x, ok in zip(lon[np.minimum(lat + 1, len(lon) - 1)].tolist(), paired.tolist())]))
    ends = np.searchsorted(own[lat], np.arange(len(texts) + 1)).tolist()
    return [points[a:b] for a, b in zip(ends, ends[1:])]


def polyline_points(legs: DataFrame, keys: list[str], precision: int = 6) -> DataFrame:
    """(keys, point, lat, lon) of legs with an encoded ``shape``: decoded where a leg lies, so nothing is moved or sorted."""

    @F.pandas_udf("array<struct<point: int, lat: double, lon: double>>")
    def decode(shape: pd.Series) -> pd.Series:
        return pd.Series(_decoded(shape, precision))

    return legs.select(*keys, F.inline(decode("shape")))


def trip_lines_from_legs(points: DataFrame, trip: str, leg: str) -> DataFrame:
    """One line a trip from the points of its legs in order."""
    line = F.array_sort(F.collect_list(F.struct(leg, "point", "lon", "lat")))
    return points.groupBy(trip).agg(line.alias("_l")).select(trip, F.transform("_l", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def connectors(lines: DataFrame, locations: DataFrame, trip: str, threshold_m: float = 20.0) -> DataFrame:
    """(trip, end, meters) of gaps between a trip's first or last location and its line that are longer than the threshold."""
    met = lines.join(locations, trip)
    ends = F.array(
        F.struct(F.lit("start").alias("end"), F.col("locations")[0].alias("p"), F.col("line")[0].alias("q")),
        F.struct(F.lit("end").alias("end"), F.element_at("locations", -1).alias("p"), F.element_at("line", -1).alias("q")),
    )
    each = met.select(trip, F.inline(ends))
    return each.select(trip, "end", S.haversine_m("p.lon", "p.lat", "q.lon", "q.lat").alias("meters")).filter(F.col("meters") > threshold_m)


def trip_bounds(trips: DataFrame, points: DataFrame, trip: str) -> DataFrame:
    """A trip's summary box if all four numbers are finite, else the box of its points, else null."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    sides = ("west", "south", "east", "north")
    all_ok = ok(sides[0]) & ok(sides[1]) & ok(sides[2]) & ok(sides[3])
    own = points.groupBy(trip).agg(F.min("lon").alias("_west"), F.min("lat").alias("_south"), F.max("lon").alias("_east"), F.max("lat").alias("_north"))
    return trips.join(own, trip, "left").select(trip, *[F.when(all_ok, F.col(s)).otherwise(F.col(f"_{s}")).alias(s) for s in sides])
