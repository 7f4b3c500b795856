"""Exact top-k by inner product over a pivot-distance index.

An inner product search becomes a search for near points when every vector gets one more entry that brings it to the length of
the longest: then |q - o|^2 = |q|^2 + M^2 - 2 q o. The pivots are k-means centres of a bounded sample. Each distinct vector is keyed by its
nearest pivot and its distance to it, and the index is stored in that order; runs of distances make annuli, of which each pivot has
as many as its rows need. The distance of a query to an annulus is at least

* how far its own distance to the pivot lies outside the annulus, and
* half of what that pivot is farther from the query than the query's nearest pivot, as the annulus' vectors are nearest to theirs.

A query goes to its annuli by falling bound on the score: to the first, then three more, then twelve, and so on, until the
bound of the next is below its k-th score. In an annulus its score with every vector is computed. Nothing is left out: the sample decides only
where the pivots lie.

Rows with one vector are one entry with the smallest k + 1 ids, more of them can't be asked for. Large annuli are dealt in blocks, and the queries
of a block in parts, so a task holds one block and a batch of queries.

Defined cases: vectors are those of ``whitening.whole_numbers`` (null, short, or with a null or non-finite entry: no part); rows
that repeat an id and vector are rows of their own, and so are partners of each other: a query leaves out only itself; a null id is never a query, and as a
partner comes after all others; with fewer than k partners all are given, an empty table gives no rows; further columns are ignored.
Scores that a long cannot hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table
from .whitening import matrix, whole_numbers

K = 20
#: Vectors that pivots are fitted to, pivots at most, rings of equal width about each from which annuli are put together.
SAMPLE, PIVOTS, RINGS = 4096, 256, 256
#: Distinct vectors in an annulus and in a block of it, queries of a block that go to one task.
BLOCK, QUERIES = 2048, 1 << 14
#: Cells of the table of bounds that a task makes at a time, and scores.
CELLS = 1 << 21


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means centres: farthest points first, then a few rounds of means."""
    rows = sample[np.lexsort(sample.T[::-1])]
    chosen, far = [0], np.full(len(rows), np.inf)
    for _ in range(1, min(k, len(rows))):
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        if not far.max():
            break
        chosen.append(int(far.argmax()))
    centres = rows[chosen]
    for _ in range(6):
        near = _distances(rows, centres).argmin(1)
        many = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _lifted(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """With one more entry: what a vector lacks to the longest; for a query 0."""
    x = x.astype(float)
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
    return np.hstack([x, more[:, None]])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they hold every sum, else in whole numbers."""
    size = lambda x: int(np.abs(x).max(initial=0))
    most = size(a) * size(b) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >> 63:
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


@dataclass(frozen=True)
class Annulus:
    pivot: int
    near: float
    far: float
    n: int
    first: int
    blocks: int


@dataclass(frozen=True)
class PivotIndex:
    """``entries`` (x, ids, block), written in the order of pivot and distance; ``depth``: ids that an entry has at most."""

    entries: DataFrame | None
    pivots: np.ndarray
    longest: float
    annuli: tuple[Annulus, ...]
    depth: int


def build(rows: DataFrame, k: int = K) -> PivotIndex:
    """The index of (vec_id, x) for searches of up to ``k`` partners."""
    spark = rows.sparkSession
    # Null ids last; the rank's limit is applied before rows are moved, so a vector that many rows share moves few of them.
    order = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last()))).filter(F.col("_r") <= k + 1)
    distinct = materialise(ranked.groupBy("x").agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["vec_id"]).alias("ids")), "distinct-vectors")
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(length)).first()
    if not n:
        return PivotIndex(None, np.zeros((0, 0)), 0.0, (), k + 1)
    # Rows with the smallest hashes: a sample of bounded size, the same every time.
    sample = np.array([r["x"] for r in distinct.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).collect()], np.int64)
    pivots = _pivots(_lifted(sample, longest), max(1, min(PIVOTS, n // (2 * BLOCK))))
    reach = 2 * float(np.sqrt(longest)) * 1.001 + 1e-9

    schema = pa.schema([("x", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("pivot", pa.int32()), ("ring", pa.int32()), ("distance", pa.float64())])

    def keyed(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                d = _distances(_lifted(matrix(b.column(0)), longest), pivots)
                near = d.argmin(1).astype(np.int32)
                own = d[np.arange(len(d)), near]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), pa.array(np.minimum(own / reach * RINGS, RINGS - 1).astype(np.int32)), pa.array(own)], schema=schema)

    placed = distinct.mapInArrow(keyed, "x array<long>, ids array<long>, pivot int, ring int, distance double")
    stored = materialise(placed.repartitionByRange("pivot", "distance").sortWithinPartitions("pivot", "distance"), "pivot-index")
    # At most PIVOTS * RINGS rows.
    rings = stored.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")).orderBy("pivot", "ring").collect()
    annuli: list[Annulus] = []
    where, first = [], 0
    group: list = []
    for r, after in zip(rings, [*rings[1:], None]):
        group.append(r)
        many = sum(g["n"] for g in group)
        if after is None or after["pivot"] != r["pivot"] or many + after["n"] > BLOCK:
            blocks = -(-many // BLOCK)
            where += [(g["pivot"], g["ring"], first, blocks) for g in group]
            annuli.append(Annulus(r["pivot"], min(g["near"] for g in group), max(g["far"] for g in group), many, first, blocks))
            first += blocks
            group = []
    places = spark.createDataFrame(where, "pivot int, ring int, first int, blocks int")
    entries = stored.join(F.broadcast(places), ["pivot", "ring"]).select("x", "ids", (F.col("first") + F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")).alias("block"))
    return PivotIndex(entries, pivots, longest, tuple(annuli), k + 1)


def _expanded(asked: DataFrame, index: PivotIndex, start: int, stop: int) -> DataFrame:
    """(block, q, query_id, x, least): each query with the blocks of its annuli from ``start`` to ``stop`` by falling bound, as long as that reaches its ``least`` score."""
    schema = pa.schema([("block", pa.int32()), ("q", pa.int64()), ("query_id", pa.int64()), ("x", pa.list_(pa.int64())), ("least", pa.int64())])
    annuli, pivots, longest = index.annuli, index.pivots, index.longest

    def run(batches: Iterator[pa.RecordBatch]):
        of = np.array([a.pivot for a in annuli])
        near, far = np.array([a.near for a in annuli]), np.array([a.far for a in annuli])
        first, blocks = np.array([a.first for a in annuli]), np.array([a.blocks for a in annuli])
        step = max(1, CELLS // len(annuli))
        for b in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            x = _lifted(matrix(b.column(2)), longest, query=True)
            d = _distances(x, pivots)
            own = d[:, of]
            gap = np.maximum(np.maximum(near - own, own - far), (own - d.min(1)[:, None]) / 2)
            size = (x * x).sum(1)[:, None] + longest
            # Distances are rounded; the bound is let out by far more than that.
            bound = (size - np.maximum(gap, 0) ** 2) / 2 + 1e-7 * (1 + size)
            order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
            least = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            wanted = ~(np.take_along_axis(bound, order, 1) < least[:, None])
            row, at = np.nonzero(wanted)
            annulus = order[row, at]
            again = np.repeat(np.arange(len(row)), blocks[annulus])
            nth = np.arange(len(again)) - np.repeat(np.cumsum(blocks[annulus]) - blocks[annulus], blocks[annulus])
            take = pa.array(row[again])
            yield pa.RecordBatch.from_arrays([pa.array((first[annulus][again] + nth).astype(np.int32)), *(b.column(c).take(take) for c in range(4))], schema=schema)

    return asked.select("q", "query_id", "x", "least").mapInArrow(run, "block int, q long, query_id long, x array<long>, least long")


def _best(x: np.ndarray, ids: list[int | None], owner: np.ndarray, q: np.ndarray, query_id: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(q, vec_id, score): for each query of ``y`` the best ``k`` rows of a block, itself left out once."""
    known = {row.tobytes(): i for i, row in enumerate(np.ascontiguousarray(x))}
    starts = np.searchsorted(owner, np.arange(len(x) + 1))
    score = _products(y, x)
    # The query's own row may be one of them, so one entry more.
    most = min(k + 1, len(x))
    bar = np.partition(score, len(x) - most, axis=1)[:, len(x) - most] if most < len(x) else score.min(1)
    row, entry = np.nonzero(score >= np.maximum(bar, least)[:, None])
    many = starts[entry + 1] - starts[entry]
    again = np.repeat(np.arange(len(row)), many)
    place = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many) + starts[entry][again]
    row, entry = row[again], entry[again]
    none = np.array([i is None for i in ids])
    numbers = np.array([0 if i is None else i for i in ids], np.int64)
    own = np.array([known.get(r.tobytes(), -1) for r in np.ascontiguousarray(y)])
    same = (own[row] == entry) & ~none[place] & (numbers[place] == query_id[row])
    # Of equal rows only the first is the query's own.
    same &= ~np.r_[False, same[:-1] & (row[1:] == row[:-1]) & (entry[1:] == entry[:-1])] if len(same) else same
    row, place, entry = row[~same], place[~same], entry[~same]
    found = score[row, entry]
    order = np.lexsort((numbers[place], none[place], -found, row))
    row, place, found = row[order], place[order], found[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    row, place, found = row[nth < k], place[nth < k], found[nth < k]
    return q[row], [ids[p] for p in place.tolist()], found


def _scored(pairs: DataFrame, index: PivotIndex, k: int) -> DataFrame:
    """(q, vec_id, score) of pairs of block and query."""
    schema = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    load = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")
    null = lambda t: F.lit(None).cast(t)
    right = pairs.join(F.broadcast(load) if index.annuli[-1].first < PIVOTS * RINGS else load, "block").select("block", part.alias("part"), "q", "query_id", "x", "least", null("array<long>").alias("ids"))
    left = index.entries.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select("block", "part", *[null("long").alias(c) for c in ("q", "query_id")], "x", null("long").alias("least"), "ids")
    dealt = left.unionByName(right).repartition(partitions(pairs.sparkSession), "block", "part").sortWithinPartitions("block", "part", F.col("q").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]):
        place, xs, lists, held = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            block, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            query = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            ends = np.nonzero(np.diff(block) | np.diff(part) | np.diff(query.astype(np.int8)))[0] + 1
            for at, to in zip(np.r_[0, ends], np.r_[ends, len(block)]):
                if (block[at], part[at]) != place:
                    place, xs, lists, held = (block[at], part[at]), [], [], None
                rows = b.slice(at, to - at)
                if not query[at]:
                    xs.append(matrix(rows.column(4)))
                    lists += rows.column(6).to_pylist()
                    continue
                if held is None:
                    held = np.vstack(xs), [i for one in lists for i in one], np.repeat(np.arange(len(lists)), [len(one) for one in lists])
                step = max(1, CELLS // len(held[0]))
                for s in (rows.slice(i, step) for i in range(0, rows.num_rows, step)):
                    least = s.column(5).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                    q, ids, score = _best(*held, s.column(2).to_numpy(zero_copy_only=False), s.column(3).to_numpy(zero_copy_only=False), matrix(s.column(4)), least, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], schema=schema)

    return dealt.mapInArrow(run, "q long, vec_id long, score long")


def search(index: PivotIndex, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest score for each row of ``queries`` (vec_id, x), ties to the smaller id."""
    if k >= index.depth:
        raise ValueError("the index was built for fewer partners")
    out = "query_id long, rank int, vec_id long, score long"
    spark = queries.sparkSession
    if index.entries is None:
        return spark.createDataFrame([], out)
    asked = queries.groupBy(F.col("vec_id").cast("long").alias("query_id"), "x").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    asked = materialise(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    best = spark.createDataFrame([], "q long, vec_id long, score long")
    by_score = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    start, stop = 0, 1
    while start < len(index.annuli):
        least = best.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        pairs = materialise(_expanded(asked.join(least, "q", "left"), index, start, stop), "query-blocks")
        if pairs.isEmpty():
            break
        found = best.unionByName(_scored(pairs, index, k))
        best = materialise(found.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= k).drop("_r"), "best")
        start, stop = stop, 4 * stop
    ranked = best.withColumn("rank", F.row_number().over(by_score))
    named = ranked.join(asked.select("q", "query_id", "copies"), "q").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return named.select("query_id", "rank", "vec_id", "score")


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    return search(build(rows), rows.filter(F.col("vec_id") % 20 == 0))


OP12_SQL = """WITH e AS (SELECT vec_id, [CAST(c AS DOUBLE) FOR c IN embedding] AS d FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, row_number() OVER () AS row_no, [floor(64 * c) FOR c IN d] AS x FROM e WHERE len(d) > 0 AND len(d) = len([c FOR c IN d IF c IS NOT NULL AND isfinite(c)]) AND len(d) = (SELECT max(len(d)) FROM e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS rank
FROM (SELECT a.vec_id AS query_id, a.row_no AS query_row, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.row_no <> b.row_no)) WHERE rank <= 20"""
