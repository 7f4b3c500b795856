"""Packing by lexical retrieval: training sequences of ``WINDOW`` tokens filled with documents that are alike.

Documents are encoded once and written. They are dealt into partitions by ranges of a min-hash of their token pairs
(copies and texts with much in common so stand together; the last bits are a hash of doc_id, so any group can be
divided), cut so that partitions have like numbers of tokens, and each partition is worked through in shards of about ``SHARD`` tokens. A shard has a BM25 inverted index over
token ids, with document frequencies and mean length over all documents. The window's first document is the seed; the
shard's unused documents fill the window in order of their score for all of the seed's terms, then unused ones without
a common term. The one that reaches over the window's end is cut there, and its rest is the next seed. So every sequence
is full; what is left at the end of a partition is cut into sequences whose lengths are powers of two.

Terms in half of all documents or more have no weight and are not indexed. Defined cases: null text is empty and gives the
end id alone; repeated rows are packed each; null ids are kept; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_range, materialise, partitions, portions, slices, table
from .pieces import encoder as piece_encoder
from .pieces import REMEMBERED, forget

WINDOW = 2048
SHARD = 1 << 18
K1, B = 1.2, 0.75
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _min_hashes(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest of the mixed hashes of adjacent ids, 62 bits, of each document in a row of documents; ``ends``: where each begins (one more at the end)."""
    x = ids.astype(np.uint64)
    # A document's last id has no successor; alone it stands for itself.
    last, alone = ends[1:] - 1, np.diff(ends) == 1
    x[:-1] = x[:-1] << np.uint64(32) | x[1:]
    x[last[alone]] = ids[last[alone]]
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x[last[~alone]] = np.uint64(2**64 - 1)
    return (np.minimum.reduceat(x, ends[:-1]) >> np.uint64(2)).astype(np.int64)


def distinct_terms(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, occurrences) of the distinct ids of each document in a row of documents, by document and id: one sort of all."""
    bits = 16 if ids.dtype.itemsize == 2 else 32
    few = len(ends) <= 1 << 16 and bits == 16
    kind = np.uint32 if few else np.uint64
    key = np.repeat(np.arange(len(ends) - 1, dtype=kind), np.diff(ends)) << kind(bits) | ids.astype(kind)
    key.sort()
    starts = np.nonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))[0]
    own = key[starts]
    return (own >> kind(bits)).astype(np.int64), (own & kind((1 << bits) - 1)).astype(np.int64), np.diff(np.append(starts, len(key)))


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, remembered: int = REMEMBERED) -> DataFrame:
    """Write (doc_id, place, n_tokens, ids; terms): a row a document, and a row a task with the document frequency of each token id."""
    from tokenizers import Tokenizer

    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("terms", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = piece_encoder(lambda: Tokenizer.from_file(tokenizer_path), "spaces", tokenizer_path, limit=remembered)
        width = encoder.dtype.itemsize
        terms = np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64)
        for b in portions(batches, 1):
            coded, ends = encoder.encode(b.column(1))
            coded, ends = np.insert(coded, ends[1:], end_id), ends + np.arange(len(ends))
            terms += np.bincount(distinct_terms(coded, ends)[1], minlength=len(terms))
            places = (_min_hashes(coded, ends) >> 20 << 20) | b.column(2).to_numpy()
            ids = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(coded)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.int64()), pa.array(np.diff(ends), pa.int64()), ids, pa.nulls(b.num_rows, pa.list_(pa.int32()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([terms], pa.list_(pa.int32()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("salt"))
    return materialise(rows.mapInArrow(run, "doc_id long, place long, n_tokens long, ids binary, terms array<int>"), "packing-tokens")


class Shard:
    """A BM25 inverted index over a few documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(d) for d in docs], np.int64)
        owner, term, tf = distinct_terms(np.concatenate(docs), np.concatenate([[0], np.cumsum(size)]))
        own = idf[term] > 0
        owner, term, tf = owner[own], term[own], tf[own]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
        #: The terms of each document that are indexed.
        self.terms = np.split(term, np.searchsorted(owner, np.arange(1, len(docs))))
        order = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        n = np.bincount(term, minlength=len(idf))
        self.length, self.start = n, np.cumsum(n) - n
        self.size = len(docs)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for a query of these terms."""
        n = self.length[terms]
        ends = np.cumsum(n)
        at = np.repeat(self.start[terms] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owner[at], self.weight[at], self.size)


class Packer:
    """Fills windows from one shard after another; gives pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids)."""

    def __init__(self, part: int, idf: np.ndarray, mean: float, window: int):
        self.idf, self.mean, self.window = idf, mean, window
        self.sequence, self.room, self.open = part << 32, window, []

    def _place(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Put what fits of a document into the open window; where its rest begins."""
        n = min(self.room, len(ids) - start)
        self.open.append((doc_id, start, n, len(ids), ids))
        self.room -= n
        return start + n

    def _full(self) -> Iterator[tuple]:
        yield from self._pieces(self.open)
        self.open, self.room = [], self.window

    def _pieces(self, own) -> Iterator[tuple]:
        at = 0
        for doc_id, start, n, total, ids in own:
            yield doc_id, start, n, total, self.sequence, at, ids[start : start + n].astype("<u4").tobytes()
            at += n
        self.sequence += 1

    def pack(self, docs: list[tuple[int | None, np.ndarray]]) -> Iterator[tuple]:
        index = Shard([ids for _, ids in docs], self.idf, self.mean)
        unused = np.ones(len(docs), bool)
        nearest: Iterator[int] | None = None
        seed_terms = np.unique(self.open[0][4]) if self.open else None
        if seed_terms is not None:
            seed_terms = seed_terms[self.idf[seed_terms] > 0]
        following = 0
        while True:
            if seed_terms is not None and nearest is None:
                s = np.where(unused, index.scores(seed_terms), 0)
                near = np.nonzero(s > 0)[0]
                nearest = iter(near[np.argsort(-s[near], kind="stable")].tolist())
            k = next((k for k in nearest or () if unused[k]), None)
            if k is None:
                while following < len(docs) and not unused[following]:
                    following += 1
                if following == len(docs):
                    return
                k = following
            unused[k] = False
            if not self.open:
                seed_terms, nearest = index.terms[k], None
            doc_id, ids = docs[k]
            at = 0
            while (at := self._place(doc_id, ids, at)) < len(ids) or not self.room:
                yield from self._full()
                if at == len(ids):
                    seed_terms, nearest = None, None
                    break
                seed_terms, nearest = index.terms[k], None

    def rest(self) -> Iterator[tuple]:
        """The open window, as sequences whose lengths are powers of two."""
        left = self.window - self.room
        pieces = list(self.open)
        while left:
            size = 1 << left.bit_length() - 1
            own, need = [], size
            while need:
                doc_id, start, n, total, ids = pieces.pop(0)
                own.append((doc_id, start, min(n, need), total, ids))
                if n > need:
                    pieces.insert(0, (doc_id, start + need, n - need, total, ids))
                need -= min(n, need)
            yield from self._pieces(own)
            left -= size


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, shard: int = SHARD, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    ``remembered``: pieces of text that half of a worker's memory of encoded ones holds; it trades memory for time alone.
    """
    spark = docs.sparkSession
    coded = encode(docs, tokenizer_path, end_id, remembered)
    own = coded.filter("terms is null").drop("terms")
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # As many rows as the vocabulary has ids.
    found = coded.filter("terms is not null").select(F.posexplode("terms").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(max((r[0] for r in found), default=-1) + 1)
    for t, k in found:
        df[t] = k
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    idf[df == 0] = 0
    mean = total / max(1, n)
    wide = len(df) > 1 << 16
    statistics = spark.sparkContext.broadcast(idf)
    laid = by_range(own, "place", partitions(spark), "doc_id", weight="n_tokens").select("_part", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        packer, held, size, out = None, [], 0, []

        def rows(pieces):
            out.extend(pieces)
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)
                out.clear()

        for b in slices(batches):
            for part, doc_id, ids in zip(*(c.to_pylist() for c in b.columns)):
                packer = packer or Packer(part, statistics.value, mean, window)
                held.append((doc_id, np.frombuffer(ids, "<u4" if wide else "<u2")))
                size += len(held[-1][1])
                if size >= shard:
                    yield from rows(packer.pack(held))
                    held, size = [], 0
        if packer:
            if held:
                yield from rows(packer.pack(held))
            out.extend(packer.rest())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)

    return laid.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
