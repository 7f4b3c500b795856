"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the components that they make.

Sets of 64-bit gram hashes are ordered rare first, by the exact number of distinct sets that a gram is in. Counting takes one
shuffle of packed postings (five bytes a gram): each bucket of gram hashes finds the grams that more than one set has, and
sends those, with their counts, to the sets. Grams that are in ``HOT`` of the documents or more have no bucket: their
counts (of rows) come from partial counts of the first pass and go with their postings straight to the sets. Equal sets
make one node. A node's prefix is its first n - ceil(t n) + 1
grams; grams that no other set has come first and meet nothing, so most nodes have no prefix left to join:
two nodes that reach the threshold share a gram in both prefixes. They meet in a join on prefix grams under three filters:

* length: the smaller set has at least t times the grams of the larger;
* positional: the grams from the shared one on suffice for the overlap that the threshold needs;
* suffix: the parity bits of the sets' grams in ``BITS`` bins bound the symmetric difference from below.

Five bytes and a bucket may fold two grams of a set together. Such a set has so many grams less to show, and its prefix
is longer by as many, so no pair is lost. Sets whose first digests agree take each other's grams, without the positional
filter, and are tried as a pair.

What is left is verified on the whole sets, each pair once. Components need a spanning set of links, not every link, so where
the pairs of all grams are more than ``MANY`` times the rows, a large group of near copies is first joined to one member
for each gram, another in each of up to ``ROUNDS`` rounds, as long as that halves the pairs; only pairs whose ends are still apart are then all tried. That is
exact: two nodes of one component need no further test, and every other pair that shares a prefix gram passes the filters
and the test. Rows of one gram are dealt by salt, and pairs of a gram by blocks of ``DEAL`` rows, so no task has a whole one.

``ngram_links`` and ``ngram_link_counts`` give every link between distinct sets, or their number for each row: each lies within
a component, and there all pairs are counted on the whole sets, block by block.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer words than n make one gram; without words a document
is a component of its own; null ids join the components of equal or like texts but never name one (a component of
null ids has a null id); rows that repeat an id are one document, so what either is like is in one component;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, partitions, slices, table, text_bytes, unused
from .pieces import forget

SALTS = 64
BITS = 512
ROUNDS = 4
#: Pairs for each row of the prefix join from which a round against one member a gram comes first.
MANY = 4
#: Rows of a gram in one block of the join of all its pairs.
DEAL = 4096
#: Members that one task compares with the same node's text.
FAN = 256
#: Cells of the filter that keeps texts of nodes without a prefix from being moved: four megabytes, whatever the input.
CELLS, CHUNKS = 1 << 25, 64
#: Bits of a set's first digest, and of a gram in postings (five bytes) besides its bucket.
DIGEST_BITS, LOW_BITS = 64, 40
#: Documents whose postings are packed together, at most 2^11.
PACK = 2000
#: Share of the documents from which a gram is hot. A gram that is in twice that share of all is found in any case, as
#: packs in which it has less than the share cannot make up for the rest; hot grams number at most 1 / HOT mean sets.
HOT = 1 / 250
#: Sets and grams in a block of a component whose links are all counted; grams that are compared at a time.
BLOCK, BLOCK_GRAMS, COLUMNS = 1024, 1 << 19, 1 << 10

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text in UTF-8."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h = (h ^ h >> np.uint64(31)) * _A + w[j : len(w) - k + 1 + j]
    h = (h ^ h >> np.uint64(29)) * _B
    return np.unique(h ^ h >> np.uint64(32))


def alike(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(grams: np.ndarray, bits: int) -> tuple[int, int]:
    raw = grams.tobytes()
    return _signed(xxhash.xxh3_64_intdigest(raw) >> 64 - bits), _signed(xxhash.xxh64_intdigest(raw, 7))


def _folds(grams: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and low bits of each gram: what is left of it in postings."""
    return (grams >> np.uint64(40)).astype(np.int64) % buckets, (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


def _sets(docs: DataFrame, n: int, buckets: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, n, folded, d1, d2): size of each document's set, how many of its grams fold into others, and its digest; and the
    hot grams, folded, with the numbers of rows that have them."""

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("folded", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("often", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])

    digest_bits, low_bits, share = DIGEST_BITS, LOW_BITS, HOT

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in slices(batches, PACK):
            sets = [gram_set(t, n) for t in b.column(1).to_pylist()]
            digests = [_digest(s, digest_bits) for s in sets]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
            at, low = _folds(flat, buckets, low_bits)
            # Where bucket and bits agree, two grams of a set fold into one; of the bucket 13 bits are looked at, so more may seem to.
            own = np.sort(owner.astype(np.uint64) << np.uint64(53) | ((at & 8191) << 40 | low).astype(np.uint64))
            twice = own[1:][own[1:] == own[:-1]] >> np.uint64(53)
            folded = np.bincount(twice.astype(np.int64), minlength=len(sets))
            key = np.sort(at << 40 | low)
            often = np.zeros(0, np.int64)
            rows = often
            least = max(2, int(share * len(sets)))
            if len(key) >= least:
                # Grams that stand ``least`` places apart in the sorted row.
                often = np.unique(key[: len(key) - least + 1][key[: len(key) - least + 1] == key[least - 1 :]])
                rows = np.searchsorted(key, often, "right") - np.searchsorted(key, often, "left")
            none = pa.nulls(len(sets) - 1, pa.list_(pa.int64())) if len(sets) > 1 else None
            lists = [pa.concat_arrays([pa.array([x.tolist()], pa.list_(pa.int64())), *([none] if none is not None else [])]) if sets else pa.nulls(0, pa.list_(pa.int64())) for x in (often, rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], folded, [d for d, _ in digests], [d for _, d in digests])), *lists], schema=schema)

    found = materialise(docs.mapInArrow(run, "doc_id long, n long, folded long, d1 long, d2 long, often array<long>, rows array<long>"), "gram-sets")
    total = found.count()
    often = found.filter("often is not null").select(F.inline(F.arrays_zip("often", "rows"))).groupBy("often").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= max(2, HOT * total))
    # At most 1 / HOT mean sets, whatever the number of documents.
    return found.drop("often", "rows"), {r["often"]: r["rows"] for r in often.collect()}


def _packed(part: np.ndarray, buckets: int, *columns: tuple[np.ndarray, str]) -> Iterator[tuple]:
    """(part, bytes of each column's values) of each part that has any."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(buckets + 1))
    for p in np.nonzero(np.diff(ends))[0].tolist():
        yield p, *(c[order[ends[p] : ends[p + 1]]].astype(t).tobytes() for c, t in columns)


def _part(digests: np.ndarray, buckets: int) -> np.ndarray:
    return (digests.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _postings(docs: DataFrame, n: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """Packed, for PACK documents: (bucket, sets, counts, grams), the set digests, their numbers of grams in the bucket, and the low 40 bits
    of those; hot grams as rows (part, sets, grams, counts) as of ``_shared``, with no bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
    hottest = docs.sparkSession.sparkContext.broadcast(np.array(sorted(hot.items()), np.int64).reshape(-1, 2))

    digest_bits, low_bits = DIGEST_BITS, LOW_BITS

    def run(batches: Iterator[pa.RecordBatch]):
        names, rows = hottest.value.T
        for b in slices(batches, PACK):
            sets = [gram_set(t, n) for t in b.column(1).to_pylist()]
            digests = np.array([_digest(s, digest_bits)[0] for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            bucket, low = _folds(flat, buckets, low_bits)
            out = []
            if len(names):
                key = bucket << 40 | low
                at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                is_hot = names[at] == key
                own = digests[owner[is_hot]]
                for p, k, g, c in _packed(_part(own, buckets), buckets, (own, "<i8"), (key[is_hot], "<i8"), (rows[at[is_hot]], "<i8")):
                    out.append((None, p, k, c, g))
                low, owner, bucket = low[~is_hot], owner[~is_hot], bucket[~is_hot]
            order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
            counts = np.bincount(bucket * len(sets) + owner, minlength=buckets * len(sets)).reshape(buckets, -1)
            low = low[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            ends = np.concatenate([[0], np.cumsum(counts.sum(1))])
            for k in np.nonzero(counts.sum(1))[0].tolist():
                has = counts[k] > 0
                out.append((k, None, digests[has].astype("<i8").tobytes(), counts[k][has].astype("<u4").tobytes() if counts[k].max() > 255 else counts[k][has].astype(np.uint8).tobytes(), low[ends[k] : ends[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, "bucket int, part int, sets binary, counts binary, grams binary")


def _shared(postings: DataFrame, buckets: int) -> DataFrame:
    """(part, sets, grams, counts), packed by set digest: the grams that more than one set has, with the number of those sets. Hot ones are passed on."""
    schema = pa.schema([("part", pa.int32()), ("sets", pa.binary()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        grams, sets, at = [], [], 0
        for b in batches:
            hot = b.filter(b.column("bucket").is_null())
            if hot.num_rows:
                yield hot.select(["part", "sets", "grams", "counts"])
            b = b.filter(b.column("bucket").is_valid())
            for bucket, keys, counts, low in zip(*(b.column(c).to_pylist() for c in ("bucket", "sets", "counts", "grams"))):
                keys = np.frombuffer(keys, "<i8")
                counts = np.frombuffer(counts, np.uint8 if len(counts) == len(keys) else "<u4")
                wide = np.zeros((len(low) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
                grams.append(wide.reshape(-1).view("<i8"))
                sets.append(np.repeat(keys, counts))
                at = bucket
        if not grams:
            return
        g, k = np.concatenate(grams), np.concatenate(sets)
        del grams, sets
        order = np.lexsort((k, g))
        g, k = g[order], k[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        g, k = g[new], k[new]
        starts = np.nonzero(np.concatenate([[True], g[1:] != g[:-1]]))[0]
        size = np.diff(np.concatenate([starts, [len(g)]]))
        df = np.repeat(size, size)
        kept = df > 1
        g, k, df = g[kept] + (at << 40), k[kept], df[kept]
        if rows := list(_packed(_part(k, buckets), buckets, (k, "<i8"), (g, "<i8"), (df, "<i8"))):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return postings.repartitionById(buckets, F.coalesce("bucket", "part")).mapInArrow(run, "part int, sets binary, grams binary, counts binary")


def _prefixes(docs: DataFrame, nodes: DataFrame, n: int, percent: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """(node, n, alone, grams): the part of each node's prefix that other sets share, rare first, and the number of grams before it (null
    where another node has the same first digest). Nodes without one are left out."""
    shared = _shared(_postings(docs, n, buckets, hot), buckets)
    nothing = lambda t: F.lit(None).cast(t)
    part = F.pmod(F.col("d1"), F.lit(buckets))
    # The digest as an unsigned number: 2^64 mod buckets is added for negative ones.
    part = F.pmod(part + F.when(F.col("d1") < 0, F.lit((1 << 64) % buckets)).otherwise(0), F.lit(buckets)).cast("int")
    own = nodes.select(part.alias("part"), *[nothing("binary").alias(c) for c in ("sets", "grams", "counts")], "node", "n", "folded", "d1")
    met = shared.select("*", *[nothing("long").alias(c) for c in ("node", "n", "folded", "d1")]).unionByName(own).repartitionById(buckets, F.col("part"))
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]):
        sets, grams, counts, known = [], [], [], {}
        for b in batches:
            for k, g, c, node, size, folded, d1 in zip(*(b.column(x).to_pylist() for x in ("sets", "grams", "counts", "node", "n", "folded", "d1"))):
                if k is None:
                    known.setdefault(d1, []).append((node, size, folded))
                else:
                    sets.append(np.frombuffer(k, "<i8"))
                    grams.append(np.frombuffer(g, "<i8"))
                    counts.append(np.frombuffer(c, "<i8"))
        if not sets:
            return
        k, g, c = np.concatenate(sets), np.concatenate(grams), np.concatenate(counts)
        del sets, grams, counts
        order = np.lexsort((g, c, k))
        k, g = k[order], g[order]
        del c, order
        # Equal sets bring their hot grams each.
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
        k, g = k[new], g[new]
        starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        ends = np.concatenate([starts[1:], [len(k)]])
        rows = []
        for i, j in zip(starts.tolist(), ends.tolist()):
            own = known[int(k[i])]
            for node, size, folded in own:
                take = (j - i) - -(-percent * size // 100) + 1 + folded if len(own) == 1 else j - i
                if take > 0:
                    rows.append((node, size, size - (j - i) if len(own) == 1 else None, g[i : min(j, i + take)].tolist()))
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 5000]), schema)], schema=schema)

    return materialise(met.mapInArrow(run, "node long, n long, alone long, grams array<long>"), "prefixes")


def _cells(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids: CELLS of them, whatever the input."""
    step = CELLS // CHUNKS

    def mark(batches: Iterator[pa.RecordBatch]):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(1).to_numpy()
            for chunk in np.unique(b.column(0).to_numpy()).tolist():
                found.setdefault(chunk, np.zeros(step, bool))[at[b.column(0).to_numpy() == chunk]] = True
        yield pa.RecordBatch.from_pydict({"chunk": list(found), "bits": [np.packbits(f).tobytes() for f in found.values()]}, pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    placed = ids.select(F.floor(cell / step).cast("int").alias("chunk"), (cell % step).alias("at")).repartition(min(CHUNKS, partitions(ids.sparkSession)), "chunk")
    out = np.zeros((CHUNKS, step // 8), np.uint8)
    for r in placed.mapInArrow(mark, "chunk int, bits binary").collect():
        out[r["chunk"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _texts(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, text, bits) of the wanted nodes (node, d1, d2, n, doc_id). Most other texts are left out before any is moved; the rest
    meet their nodes by digest."""
    cells = rows.sparkSession.sparkContext.broadcast(_cells(wanted))
    schema = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("text", pa.binary()), ("bits", pa.list_(pa.int64()))])

    digest_bits = DIGEST_BITS

    def near(batches: Iterator[pa.RecordBatch]):
        bits, seen = cells.value, set()
        for b in slices(batches):
            at = b.column(2).to_numpy()
            hit = bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            some = b.filter(pa.array(hit.astype(bool)))
            out = []
            for doc_id, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                s = gram_set(t, n)
                d = _digest(s, digest_bits)
                # Rows without an id: one a set is enough.
                if doc_id is None:
                    if d in seen:
                        continue
                    seen.add(d)
                odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
                out.append((doc_id, *d, t, np.packbits(odd.astype(np.uint8)).view(">i8").tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

    some = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))).mapInArrow(near, "id long, d1 long, d2 long, text binary, bits array<long>")
    met = some.join(wanted, ["d1", "d2"]).filter(F.col("id").eqNullSafe(F.col("doc_id")))
    return materialise(met.select("node", "text", "bits"), "texts")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Overlap that sets of a and b grams need."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def _length_and_position(a: str, b: str, percent: int) -> Column:
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    # ``least`` passes over nulls; a node without positions passes.
    placed = F.when(i.isNotNull() & j.isNotNull(), F.least(n - i, m - j) >= _needed(n, m, percent) - F.least(i, j)).otherwise(True)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & placed


def _suffix(a: str, b: str, percent: int) -> Column:
    apart = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(BITS // 64)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return apart <= n + m - 2 * _needed(n, m, percent)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair, from the whole sets. A node's text goes to the pairs in which it is b; a's goes to each FAN of them once."""
    own = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(FAN)))
    members = own.join(texts, own["b"] == texts["node"]).select("a", "salt", "b", "text")
    heads = own.select("a", "salt").distinct().join(texts, F.col("a") == texts["node"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    met = members.unionByName(heads).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]):
        head = None
        for b in slices(batches):
            out = []
            for x, y, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                s = gram_set(t, n)
                if y is None:
                    head = s
                else:
                    out.append((x, y, alike(len(np.intersect1d(head, s, assume_unique=True)), len(head), len(s), percent)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "linked"])

    return met.mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b): equal labels for the nodes of a component.

    Each step hooks every node to the neighbour (or itself) that has most neighbours, ties in an order drawn anew, and
    contracts. A star is gone after one step, a chain after a number of steps that grows with its length's logarithm.
    Steps are written, not kept in memory.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = materialise(both(edges).filter("a != b").distinct(), "cc-edges")
    labels, step = None, 0
    while not live.isEmpty():
        step += 1
        degree = live.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("d"))
        rank = lambda d, c: F.struct((-F.col(d)).alias("d"), F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        hook = live.join(degree, "b").groupBy("a").agg(F.min(rank("d", "b")).alias("best"), F.count(F.lit(1)).alias("own"))
        hook = materialise(hook.select(F.col("a").alias("label"), F.least("best", rank("own", "a"))["to"].alias("to")), "cc-hook")
        if labels is None:
            labels = hook.select(F.col("label").alias("node"), F.col("to").alias("label"))
        else:
            labels = materialise(labels.join(hook, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        ends = live.join(hook.select(F.col("label").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("label").alias("b"), F.col("to").alias("y")), "b")
        live = materialise(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").distinct(), "cc-edges")
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _apart(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix rows (gram, node, label, n, at, pos) of the grams whose nodes are in more than one component; and of their gram ``k``, its number of rows,
    ``main``, the component with most of them, and ``rest``, the number of rows in others."""
    own = found.withColumn("label", F.col("node")) if labels is None else found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = own.select("node", "label", "n", "alone", F.posexplode("grams").alias("at", "gram")).withColumn("pos", F.col("alone") + F.col("at")).drop("alone")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    sizes = salted.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("gram").agg(F.sum("n").alias("k"), F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    whole = whole.select("gram", "k", F.col("m.label").alias("main"), (F.col("k") - F.col("m.n")).alias("rest"))
    return salted.join(salted.select("gram", "salt").distinct().join(whole, "gram"), ["gram", "salt"]).drop("salt")


def _first_members(own: DataFrame, step: int, percent: int) -> DataFrame:
    """(x, y): each prefix row as y beside one member of its gram, the first in an order drawn anew; the same one for most grams of a group."""
    order = F.struct(F.xxhash64("node", F.lit(step)).alias("o"), "node", "label", "n", "pos")
    salted = own.select("gram", "node", "label", "n", "pos", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    # A gram's rows are dealt by salt, and the first of all goes back to the salts at which it has rows.
    parts = salted.groupBy("gram", "salt").agg(F.min(order).alias("f"))
    first = parts.groupBy("gram").agg(F.min("f").alias("f"), F.collect_set("salt").alias("salts")).select("gram", "f", F.explode("salts").alias("salt"))
    met = salted.join(first, ["gram", "salt"])
    met = met.select(F.struct("f.node", "f.label", "f.n", "f.pos").alias("x"), F.struct("node", "label", "n", "pos").alias("y"))
    return met.filter("x.label != y.label").filter(_length_and_position("x", "y", percent))


def _all_members(own: DataFrame, found: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(x, y) for all pairs of a gram's members in different components that pass the filters, at the first gram that both prefixes have."""
    # Two rows of the main component make no pair, so one of each pair is of another; those are x. Each side is dealt into blocks.
    own = own.join(found.select("node", "grams"), "node").join(texts.select("node", "bits").dropDuplicates(["node"]), "node")
    left, right = (F.ceil(F.col(c) / DEAL).cast("int") for c in ("rest", "k"))
    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    row = F.struct("node", "label", "n", "pos", "at", "grams", "bits")
    x = own.filter("label != main").select("gram", place(left).alias("i"), F.explode(F.sequence(F.lit(0), right - 1)).alias("j"), row.alias("x"))
    y = own.select("gram", F.explode(F.sequence(F.lit(0), left - 1)).alias("i"), place(right).alias("j"), (F.col("label") == F.col("main")).alias("is_main"), row.alias("y"))
    once = F.col("is_main") | (F.col("x.node") < F.col("y.node"))
    # A pair counts at the first gram that both prefixes have.
    first = ~F.arrays_overlap(F.slice("x.grams", F.lit(1), F.col("x.at")), F.slice("y.grams", F.lit(1), F.col("y.at")))
    return x.join(y, ["gram", "i", "j"]).filter((F.col("x.label") != F.col("y.label")) & once & _length_and_position("x", "y", percent) & _suffix("x", "y", percent) & first)


def _joined(docs: DataFrame, n: int, percent: int, text: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of the rows, their nodes, texts of the nodes that may have links, and labels of those in components."""
    buckets = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    sets, hot = _sets(rows, n, buckets)
    sets = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # Equal sets are one node; no task holds more of a group than a row for each salt.
    parts = sets.filter("n > 0").groupBy("d1", "d2", "n", "folded", "salt").agg(F.min("doc_id").alias("rep"))
    nodes = parts.groupBy("d1", "d2", "n", "folded").agg(F.min("rep").alias("rep"), F.collect_set("salt").alias("salts"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    found = _prefixes(rows, nodes, n, percent, buckets, hot)
    own = materialise(_apart(found, None), "shared-grams")
    # Nodes whose first digests agree stand for each other in the counts, so they are tried in any case. Hardly ever any.
    twins = materialise(nodes.groupBy("d1").agg(F.sort_array(F.collect_list("node")).alias("own")).filter(F.size("own") > 1), "twins")
    twins = twins.select(F.explode(F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    wanted = own.select("node").unionByName(twins.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = wanted.join(nodes, "node").select("node", "d1", "d2", F.col("rep").alias("doc_id"))
    texts = _texts(rows, materialise(wanted, "wanted"), n)

    same = materialise(_same_ids(sets, nodes), "same-ids")
    verified, labels, step, before = None, None, 0, math.inf
    while True:
        if labels is not None:
            own = materialise(_apart(found, labels), "apart")
        # Rows, and the pairs that a join of all would look at: one number each.
        had, many = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("rest").cast("double")), F.lit(0.0))).first()
        if not had and verified is not None:
            break
        # Where a round has not halved the pairs, another would not help either.
        last = step == ROUNDS or many <= MANY * had or many > before / 2
        before = many
        met = _all_members(own, found, texts, percent) if last else _first_members(own, step, percent)
        pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if verified is None:
            pairs = pairs.unionByName(twins).distinct()
        else:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        new = materialise(_verified(materialise(pairs, "pairs"), texts, n, percent), "verified")
        verified = new if verified is None else verified.unionByName(new)
        labels = components(verified.filter("linked").select("a", "b").unionByName(same))
        if last:
            break
        step += 1

    return sets, nodes, texts, labels


def _of_rows(sets: DataFrame, nodes: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, and ``more`` columns of nodes, 0 for rows without words) of each row."""
    of_node = nodes.join(labels, "node", "left").select("node", "d1", "d2", "n", "salts", "rep", *more, F.coalesce("label", "node").alias("label"))
    least = of_node.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = of_node.join(least, "label").select("d1", "d2", F.col("n").alias("_n"), F.explode("salts").alias("salt"), "component_id", *more)
    out = sets.join(of_set, (sets["d1"] == of_set["d1"]) & (sets["d2"] == of_set["d2"]) & (sets["n"] == of_set["_n"]) & (sets["salt"] == of_set["salt"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in more])


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Numbers of common grams of each of the sets ``xs`` with each of ``ys``."""
    (g, x), (h, y) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(a) for a in s])) for s in (xs, ys))
    out = np.zeros((len(xs), len(ys)), np.int32)
    common = np.intersect1d(g, h)

    def placed(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
        hit = common[at] == grams if len(common) else np.zeros(len(grams), bool)
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (i, x), (j, y) = placed(g, x), placed(h, y)
    for at in range(0, len(common), COLUMNS):
        # Counts below 2^24 are exact in single precision.
        width, sides = min(COLUMNS, len(common) - at), []
        for k, owner, n in ((i, x, len(xs)), (j, y, len(ys))):
            lo, hi = np.searchsorted(k, [at, at + width])
            side = np.zeros((n, width), np.float32)
            side[owner[lo:hi], k[lo:hi] - at] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    return out


def _links(texts: DataFrame, labels: DataFrame, n: int, percent: int, count: bool) -> DataFrame:
    """All links between nodes: (a, b, common), or with ``count`` (node, k), whose sums are the nodes' numbers of links.

    Every link is within a component. A component is dealt into blocks, each pair of blocks is one group, and all pairs of
    its sets are counted at once; the rows that are moved are a component's size squared over ``BLOCK``.
    """

    def grams(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            sets = [gram_set(t, n) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "label", "n", "grams"])

    own = texts.dropDuplicates(["node"]).join(labels, "node").select("node", "label", "text")
    own = materialise(own.mapInArrow(grams, "node long, label long, n long, grams binary"), "link-sets")
    blocks = own.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = own.join(blocks, "label").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), (F.col("at") > F.col("other")).alias("second"), "node", "grams")
    met = met.repartition(partitions(texts.sparkSession), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    fields = (("node", pa.int64()), ("k", pa.int64())) if count else (("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()))

    def linked(one: bool, first: list, second: list) -> list[np.ndarray]:
        ys = first if one else second
        if not first or not ys:
            return [np.zeros(0, np.int64)] * len(fields)
        (a, xs), (b, zs) = zip(*first), zip(*ys)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        common = overlaps(list(xs), list(zs))
        sizes = [np.array([len(x) for x in side], np.int64) for side in (xs, zs)]
        # 100 i >= p (a + b - i), row by row, so that no more than the counts are held.
        hit = np.stack([(100 + percent) * row.astype(np.int64) >= percent * (size + sizes[1]) for row, size in zip(common, sizes[0].tolist())])
        if one:
            hit &= a[:, None] < b[None, :]
        if count:
            node, k = np.concatenate([a, b]), np.concatenate([hit.sum(1), hit.sum(0)])
            return [node[k > 0], k[k > 0]]
        i, j = np.nonzero(hit)
        return [np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), common[i, j]]

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        key, sides = None, ([], [])

        def done():
            found = linked(key[1] == key[2], *sides)
            for at in range(0, len(found[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 10_000], t) for c, (_, t) in zip(found, fields)], [f for f, _ in fields])

        for b in slices(batches):
            for label, lo, hi, second, node, raw in zip(*(c.to_pylist() for c in b.columns)):
                if key != (label, lo, hi):
                    if key:
                        yield from done()
                    key, sides = (label, lo, hi), ([], [])
                sides[second].append((node, np.frombuffer(raw, np.uint64)))
        if key:
            yield from done()

    return met.mapInArrow(run, ", ".join(f"{f} long" for f, _ in fields))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents whose Jaccard similarity is ``percent`` / 100 or more are linked."""
    sets, nodes, _, labels = _joined(docs, n, percent, text, id_col)
    return _of_rows(sets, nodes, labels)


def ngram_link_counts(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As ``ngram_components``, and ``n_links``: how many other distinct sets the row's set is linked to."""
    sets, nodes, texts, labels = _joined(docs, n, percent, text, id_col)
    links = _links(texts, labels, n, percent, True).groupBy("node").agg(F.sum("k").alias("n_links"))
    return _of_rows(sets, nodes.join(links, "node", "left"), labels, "n_links")


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b, n_a, n_b, common) of every linked pair of distinct sets, each named by its smallest doc_id (null if it has none)."""
    _, nodes, texts, labels = _joined(docs, n, percent, text, id_col)
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("rep").alias(f"doc_{c}"), F.col("n").alias(f"n_{c}"))
    return _links(texts, labels, n, percent, False).join(end("a"), "a").join(end("b"), "b").select("doc_a", "doc_b", "n_a", "n_b", "common")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their columns, that stay when of each component one document does: the one with the smallest id.

    Rows that repeat an id are one document, and stay or go together. Rows with a null id stay only where the whole
    component has none, one row of it; those without words are components of their own and all stay.
    """
    sets, nodes, _, labels = _joined(docs, n, percent, text, id_col)
    chosen = _of_rows(sets, nodes, labels).filter("doc_id = component_id").select(F.col("doc_id").alias(unused("_kept", *docs.columns))).distinct()
    named = docs.join(chosen, docs[id_col].cast("long") == chosen[chosen.columns[0]], "left_semi")

    nameless = docs.filter(F.col(id_col).isNull())
    d1, d2 = unused("_d1", *docs.columns), unused("_d2", *docs.columns)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(d1, T.LongType()), T.StructField(d2, T.LongType())])

    digest_bits = DIGEST_BITS

    def digested(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            found = [_digest(s, digest_bits) if len(s := gram_set((t or "").encode("utf-8", "surrogatepass"), n)) else (None, None) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], [f.name for f in schema.fields])

    own = nameless.mapInArrow(digested, schema)
    label = unused("_label", *docs.columns)
    of_node = nodes.join(labels, "node", "left").select("d1", "d2", "rep", F.coalesce("label", "node").alias(label))
    lost = of_node.groupBy(label).agg(F.max("rep").alias("rep")).filter("rep is null").select(label)
    of_node = of_node.join(lost, label, "left_semi").select(F.col("d1").alias("x"), F.col("d2").alias("y"), label)
    met = own.join(of_node, (own[d1] == of_node["x"]) & (own[d2] == of_node["y"]))
    one = met.select(*[own[f"`{c}`"] for c in docs.columns], label).dropDuplicates([label]).drop(label)
    return named.unionByName(own.filter(F.col(d1).isNull()).drop(d1, d2)).unionByName(one)


def _same_ids(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of rows that repeat an id."""
    again = sets.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("d1", "d2", "n").alias("k")).filter("k > 1").select("doc_id")
    own = sets.filter("n > 0").join(again, "doc_id", "left_semi").join(nodes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"]).select("doc_id", "node")
    first = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    return own.join(first, "doc_id").select("a", F.col("node").alias("b")).filter("a != b")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_link_counts(table(spark, sf_dir, "documents"), 4, 85)
