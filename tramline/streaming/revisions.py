"""Latest revision of each tile as a stream: requests and parse results in any order.

A tile's state is the last revision that was requested, what the newest older revision has shown, and one entry for each
revision that may still count: those from the last requested one on. When a newer request comes, entries before it are folded into what was
shown and dropped. The outcome does not depend on the order in which rows arrive; it is that of ``rolling.latest_revision``
over all rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that go in: a request has no ``ok``; ``seq`` orders the results of a revision.
IN = "tile long, revision long, seq long, ok boolean, payload string"
OUT = "tile long, revision long, payload string"


class Revisions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = handle.getValueState("asked", "revision long")
        self.before = handle.getValueState("before", "revision long, seq long, payload string")
        # The last result of a revision, and its last one that shows something.
        self.results = handle.getMapState("results", "revision long", "seq long, ok boolean, payload string, shown_seq long, shown string")

    def _show(self, revision: int, seq: int, payload: str) -> None:
        old = self.before.get()
        if old is None or (old[0], old[1]) < (revision, seq):
            self.before.update((revision, seq, payload))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        request = new["ok"].isna()
        old = self.asked.get()
        asked = max([*([old[0]] if old else []), *map(int, new.loc[request, "revision"])], default=None)
        # State is read once and written once a batch, however many rows there are: results are brought together before.
        known = {k[0]: tuple(v) for k, v in self.results.iterator()} if self.results.exists() else {}
        entries, before = dict(known), None
        for revision, seq, ok, payload in new.loc[~request, ["revision", "seq", "ok", "payload"]].itertuples(index=False):
            revision, seq, ok = int(revision), int(seq), bool(ok)
            shows = ok and payload != ""
            if asked is not None and revision < asked:
                if shows and (before is None or before[:2] < (revision, seq)):
                    before = (revision, seq, payload)
                continue
            entry = entries.get(revision, (-(1 << 62), False, "", -(1 << 62), None))
            last = (seq, ok, payload) if seq > entry[0] else entry[:3]
            shown = (seq, payload) if shows and seq > entry[3] else entry[3:]
            entries[revision] = (*last, *shown)
        if asked is not None and (old is None or old[0] != asked):
            self.asked.update((asked,))
            for revision in [r for r in entries if r < asked]:
                done = entries.pop(revision)
                if done[4] is not None and (before is None or before[:2] < (revision, done[3])):
                    before = (revision, done[3], done[4])
        for revision in known.keys() - entries.keys():
            self.results.removeKey((revision,))
        for revision, entry in entries.items():
            if known.get(revision) != entry:
                self.results.updateValue((revision,), entry)
        if before is not None:
            self._show(*before)
        if asked is None:
            return
        now = entries.get(asked)
        before = self.before.get()
        if now is None or (now[1] and now[2] == ""):
            payload = before[2] if before else None
        else:
            payload = now[2] if now[1] else None
        yield pd.DataFrame({"tile": [key[0]], "revision": [asked], "payload": pd.Series([payload], dtype=object)})

    def close(self) -> None:
        pass


def latest_revisions(rows: DataFrame) -> DataFrame:
    """What each tile of the stream ``rows`` (as of ``IN``) shows now, for update mode: a row each time that rows of it arrive."""
    return rows.groupBy("tile").transformWithStateInPandas(Revisions(), OUT, "Update", "None")
