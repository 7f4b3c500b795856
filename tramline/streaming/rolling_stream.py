"""Rolling statistics over a stream in event time, with state by key that a batch appends to.

Samples wait in a list state until the watermark is past their millisecond; then no sample of that or an earlier one can come, and they
are given out in order of time with the statistics that the batch windows have: frames by range, so samples that tie count for each
other. So the result does not depend on how samples fall into micro-batches. Samples later than the watermark are left
out. Those that the final watermark has not passed are not given out yet.

State of a key:

* ``arrived``: a list of samples that wait, to which a batch appends; a timer stands at the first of them;
* ``samples``: what has been given out and a later frame may reach, by chunks of ``CHUNK_MS`` of event time, so that a chunk is written
  as often as the watermark stops in it; what no later frame can reach is not written, and one timer ends the last;
* ``given``: the time up to which samples have been given out.

A timer that fires reads the chunks from a window before the first sample to be given out, and gives out what the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rolling import BUCKET_MS, CAP_MS, percentiles

RATE_MS, RATE_LEAST = 1_000, 1_000
#: The trailing windows, in milliseconds.
WINDOWS = {"10s": 10_000, "1m": 60_000, "5m": 300_000}
KEEP_MS = max(WINDOWS.values())
TIMELINE_MS = 10_000
CHUNK_MS = 60_000
#: ``recent_from``: the first sample of the timeline, which are those of the last ten seconds.
OUT = "user_id long, event_id long, ended_ms long, recent_from long, rate double, " + ", ".join(f"n_{w} long, min_{w} double, avg_{w} double, p90_{w} double, max_{w} double" for w in WINDOWS)
#: The state store that list and map states and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _most(value: np.ndarray, start: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The largest of value[start:until], by tables of the largest of 1, 2, 4, ... values."""
    tables = [value]
    while (step := 1 << len(tables) - 1) * 2 <= len(value):
        tables.append(np.maximum(tables[-1][:-step], tables[-1][step:]))
    level = np.frexp((until - start).astype(np.float64))[1] - 1
    most = np.empty(len(until))
    for k in np.unique(level):
        at = level == k
        most[at] = np.maximum(tables[k][start[at]], tables[k][until[at] - (1 << int(k))])
    return most


def trailing(ms: np.ndarray, value: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """For the sorted times from place ``first`` on: the rate, and count, least, mean, percentile and largest of each window."""
    until = np.searchsorted(ms, ms[first:], "right")
    since = np.searchsorted(ms, ms[first:] - RATE_MS, "left")
    elapsed = np.minimum(RATE_MS, np.maximum(ms[first:] - ms[since], RATE_LEAST))
    out = {"rate": (until - since) / (elapsed / 1000.0)}
    buckets = np.clip(np.floor(value / BUCKET_MS + 0.5), 0, int(CAP_MS / BUCKET_MS)).astype(np.int64)
    # Sums are taken from the first value that a frame can have, so none loses digits to a long past.
    total = np.concatenate([[0.0], np.cumsum(value - value[0])])
    for name, width in WINDOWS.items():
        start = np.searchsorted(ms, ms[first:] - width, "left")
        n = until - start
        out |= {
            f"n_{name}": n, f"min_{name}": -_most(-value, start, until), f"avg_{name}": (total[until] - total[start]) / n + value[0],
            f"p90_{name}": percentiles(ms, buckets, first, width, 0.9) * BUCKET_MS, f"max_{name}": _most(value, start, until),
        }
    return out


class Diagnostics(StatefulProcessor):
    """Samples of one user: kept by chunk, given out when a timer finds them behind the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", "event_id long, ms long, value double")
        self.samples = handle.getMapState("samples", "chunk long", "event_id array<long>, ms array<long>, value array<double>")
        self.given = handle.getValueState("given", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = self.given.get()
        new = pd.concat(list(rows))
        new = new[new["ended_ms"] >= max(given[0] if given else -(1 << 62), timerValues.getCurrentWatermarkInMs())]
        if len(new):
            self.arrived.appendList([(int(e), int(m), float(v)) for e, m, v in zip(new["event_id"], new["ended_ms"], new["duration_ms"])])
            self.handle.registerTimer(int(new["ended_ms"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        arrived = [tuple(r) for r in self.arrived.get()] if self.arrived.exists() else []
        due, wait = sorted((r for r in arrived if r[1] < mark), key=lambda r: (r[1], r[0])), [r for r in arrived if r[1] >= mark]
        if due:
            # What still waits is put back: at most what came in a delay.
            self.arrived.put(wait) if wait else self.arrived.clear()
            yield self._given_out(key, due, mark)
            self.given.update((mark,))
        if wait:
            self.handle.registerTimer(max(min(r[1] for r in wait), expiredTimerInfo.getExpiryTimeInMs() + 1))
        # A later sample is after the watermark, so its frame does not reach further back than this.
        for chunk in [k[0] for k in self.samples.keys()] if self.samples.exists() else []:
            if (chunk + 1) * CHUNK_MS <= mark - KEEP_MS:
                self.samples.removeKey((chunk,))

    def _given_out(self, key, due: list[tuple], mark: int) -> pd.DataFrame:
        reach = (due[0][1] - KEEP_MS) // CHUNK_MS
        kept = {k[0]: v for k, v in self.samples.iterator() if k[0] >= reach} if self.samples.exists() else {}
        parts = [[np.asarray(kept[c][i]) for c in sorted(kept)] + [np.array([r[i] for r in due])] for i in range(3)]
        ids, ms, value = (np.concatenate(p).astype(t) for p, t in zip(parts, (np.int64, np.int64, float)))
        first = len(ids) - len(due)
        reached = sorted(c for c in {r[1] // CHUNK_MS for r in due} if (c + 1) * CHUNK_MS > mark - KEEP_MS)
        for chunk in reached:
            a, z = np.searchsorted(ms, [chunk * CHUNK_MS, (chunk + 1) * CHUNK_MS])
            self.samples.updateValue((chunk,), (ids[a:z].tolist(), ms[a:z].tolist(), value[a:z].tolist()))
        if reached:
            self.handle.registerTimer((reached[-1] + 1) * CHUNK_MS + KEEP_MS)
        recent = ids[np.searchsorted(ms, ms[first:] - TIMELINE_MS, "left")]
        return pd.DataFrame({"user_id": [key[0]] * len(due), "event_id": ids[first:], "ended_ms": ms[first:], "recent_from": recent} | trailing(ms, value, first))

    def close(self) -> None:
        pass


def rolling_stream(samples: DataFrame, delay_ms: int = KEEP_MS) -> DataFrame:
    """Samples (user_id, event_id, ended_at, duration_ms) with trailing statistics at each, as soon as the watermark, ``delay_ms`` behind the newest sample, has
    passed it. The session's state store must be that of ``STORE``."""
    rows = samples.withWatermark("ended_at", f"{delay_ms} milliseconds").select("user_id", "event_id", F.unix_millis("ended_at").alias("ended_ms"), "duration_ms", "ended_at")
    return rows.groupBy("user_id").transformWithStateInPandas(Diagnostics(), OUT, "Append", "EventTime")
