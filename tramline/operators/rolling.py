"""Trailing-window statistics over samples (key, time, duration)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_MS, CAP_MS = 0.1, 1000.0
#: Fine buckets under one coarse count.
COARSE = 100
#: Windows that a block of a key's time spans; its rows go to one task, with those of the window before it.
SPAN = 4


def _trailing(key: str, ms: str, width: int):
    return Window.partitionBy(key).orderBy(ms).rangeBetween(-width, 0)


def rolling_rate(df: DataFrame, key: str, ms: str, width: int, least: int = 1000) -> DataFrame:
    """Samples a second over the trailing ``width`` milliseconds: their number by the time since the oldest, at least ``least`` and at most the width."""
    w = _trailing(key, ms, width)
    span = F.least(F.lit(width), F.greatest(F.col(ms) - F.min(ms).over(w), F.lit(least)))
    return df.withColumn("rate", F.count(F.lit(1)).over(w) / (span / 1000.0))


def rolling_stats(df: DataFrame, key: str, ms: str, value: str, widths: dict[str, int]) -> DataFrame:
    """Count, min, average and max of ``value`` over each trailing width; one sort serves all."""
    for name, width in widths.items():
        w = _trailing(key, ms, width)
        df = df.withColumns({f"n_{name}": F.count(value).over(w), f"min_{name}": F.min(value).over(w), f"avg_{name}": F.avg(value).over(w), f"max_{name}": F.max(value).over(w)})
    return df


def bucket(value) -> Column:
    """The nearest step of 0.1 ms, from 0 to one second."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNotNull(), F.least(F.greatest(F.floor(c / BUCKET_MS + 0.5), F.lit(0)), F.lit(int(CAP_MS / BUCKET_MS)))).cast("int")


class Histogram:
    """Counts of buckets on two levels: samples are added and taken out one by one, and a rank is found by two short walks."""

    def __init__(self) -> None:
        last = int(CAP_MS / BUCKET_MS)
        self.fine, self.coarse, self.n = [0] * (last + 1), [0] * (last // COARSE + 1), 0

    def add(self, b: int, times: int = 1) -> None:
        self.fine[b] += times
        self.coarse[b // COARSE] += times
        self.n += times

    def rank(self, share: float) -> int:
        """The bucket of the sample with nearest rank ceil(n * share), at least the first."""
        left, c = max(1, math.ceil(self.n * share)), 0
        while left > self.coarse[c]:
            left -= self.coarse[c]
            c += 1
        b = c * COARSE
        while left > self.fine[b]:
            left -= self.fine[b]
            b += 1
        return b


def percentiles(ms: np.ndarray, buckets: np.ndarray, first: int, width: int, share: float) -> np.ndarray:
    """For the sorted times from place ``first`` on: the percentile bucket of the trailing frame by range, -1 where it has no sample. Buckets below 0 are no samples.

    Each sample goes into the histogram once and out of it once.
    """
    out = np.empty(len(ms) - first, np.int64)
    times, own = ms.tolist(), buckets.tolist()
    h, start, end, known = Histogram(), 0, 0, None
    for at in range(first, len(times)):
        now = times[at]
        if now != known:
            known = now
            while end < len(times) and times[end] <= now:
                if own[end] >= 0:
                    h.add(own[end])
                end += 1
            while times[start] < now - width:
                if own[start] >= 0:
                    h.add(own[start], -1)
                start += 1
            value = h.rank(share) if h.n else -1
        out[at - first] = value
    return out


def rolling_p90(df: DataFrame, key: str, ms: str, value: str, width: int, share: float = 0.9) -> DataFrame:
    """Nearest-rank percentile over buckets of 0.1 ms, capped at one second, of each trailing frame by range: linear in the rows of a key.

    A key's time is cut into blocks of ``SPAN`` windows, and each block also gets the window before it, so a hot key is many tasks; a task
    takes the blocks it has one after another, as small ones are many. Frames without a value, and rows without a time, have null.
    """
    span = SPAN * width
    block, again = F.floor(F.col(ms) / span), F.floor((F.col(ms) + width) / span)
    names = df.columns
    dealt = df.withColumn("_k", bucket(value)).select("*", F.explode(F.when(again > block, F.array(block, again)).otherwise(F.array(block))).alias("_block")).withColumn("_own", F.coalesce(F.col("_block") == block, F.lit(True)))
    schema = T.StructType([*df.schema.fields, T.StructField("p90", T.DoubleType())])

    def found(rows: pa.Table) -> pa.RecordBatch:
        """The rows of one block, sorted, that are its own."""
        first = rows.num_rows - pc.sum(rows["_own"]).as_py()
        own = rows.slice(first)
        if rows[ms].null_count:
            p90 = pa.nulls(own.num_rows, pa.float64())
        else:
            got = percentiles(rows[ms].to_numpy().astype(np.int64), pc.fill_null(rows["_k"], -1).to_numpy().astype(np.int64), first, width, share)
            p90 = pa.array(got * BUCKET_MS, mask=got < 0)
        return own.select(names).append_column("p90", p90)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
            starts = [0, *_changes(rows, (key, "_block")), rows.num_rows]
            done = [found(rows.slice(a, z - a)) for a, z in zip(starts[:-2], starts[1:-1]) if z > a]
            # The last block may go on in the next batch.
            waiting = rows.slice(starts[-2])
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if waiting is not None and waiting.num_rows:
            yield from found(waiting).combine_chunks().to_batches()

    return dealt.repartition(key, "_block").sortWithinPartitions(key, "_block", "_own", ms).mapInArrow(run, schema)


def _changes(rows: pa.Table, columns: tuple[str, ...]) -> list[int]:
    """Places at which the value of one of ``columns`` is another than in the row before; null is a value."""
    n = rows.num_rows
    changed = np.zeros(max(0, n - 1), bool)
    for c in columns:
        a, b = rows[c].slice(0, n - 1), rows[c].slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy()
        changed |= differ | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return (np.flatnonzero(changed) + 1).tolist()


def recent(df: DataFrame, key: str, ms: str, width: int) -> DataFrame:
    """Samples within ``width`` of the newest of their key."""
    newest = df.groupBy(key).agg(F.max(ms).alias("_newest"))
    return df.join(newest, key).filter(F.col(ms) >= F.col("_newest") - width).drop("_newest")


def latest_revision(results: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """What each tile shows after parse results (key, revision, ok, payload): only results of the last requested revision count; a failed one removes the tile, an empty one leaves what was shown before it."""
    last = requests.groupBy(key).agg(F.max("revision").alias("_last"))
    current = results.join(last, key).filter(F.col("revision") == F.col("_last"))
    final = current.groupBy(key).agg(F.max_by(F.struct("ok", "payload"), "seq").alias("now"))
    shown = results.filter("ok and payload != ''").join(last, key).filter(F.col("revision") < F.col("_last")).groupBy(key).agg(F.max_by("payload", F.struct("revision", "seq")).alias("before"))
    state = last.join(final, key, "left").join(shown, key, "left")
    return state.select(key, F.when(F.col("now").isNull() | (F.col("now.ok") & (F.col("now.payload") == "")), F.col("before")).when(F.col("now.ok"), F.col("now.payload")).alias("payload"))
