"""Toxicity by the nearest labelled examples, in exact TF-IDF cosine, with calibrated scores and evidence.

Fit, on a bounded sample: ``SAMPLE`` labelled rows of the training part (the smallest hashes of doc_id). Features are all
words of these rows, and those of their prefixes of 4 to 6 letters that go with the label (chi-square of ``CHI2`` or more
in ``LEAST_DF`` rows or more), so inflected forms meet. Their document frequencies are counted over all documents. The
rows become the examples, as unit vectors of (1 + ln tf) * idf * r, where r is the absolute correlation of the feature
with the label in the sample, and ``FLOOR`` at least: a word that says nothing of the label weighs little, but counts.
Rows with equal vectors are one example that stands for as many rows, so that no id has a say in a score.

Search: examples are cut into blocks of ``BLOCK``; for each feature and block the index holds the largest weight. A
query's products with these bound every score in the block, so blocks are taken from the highest bound down, in groups
that grow (``WAVES``), until the k-th best score is above the next bound: the k nearest rows come out exactly, and with
them all that tie with the k-th. Queries go through the blocks together: postings of features that a twentieth of the
examples or more have (``DENSE`` of them at most) stand in a block as rows of a matrix, the others as lists. The matrices
are in single precision; whatever may be among the nearest by that is scored again in double precision.

Words are looked up by 64-bit hashes of their bytes, taken for all words of a batch of texts at once; those of the
vocabulary differ from each other, and one of 10^9 other words meets one of theirs with a chance below 10^-4.

Score: the votes of these rows weighted by 1 / (distance + ``SOFT``), together with ``PRIOR`` votes for the rate of texts
without features, then an isotonic step function fitted to leave-one-out votes of the sample.

The model is bounded by the words of SAMPLE rows, whatever the input. One task makes it and writes it to the shared folder, where
the tasks that score read it; it never passes the driver. Defined cases: null and
empty texts, and texts without a word of the sample, get the rate of such texts in the sample, drawn to the rate of all
of it by one row; rows without a doc_id are never learned from; labels that are null are left out, a doc_id labelled
twice counts as toxic if any row says so; without a usable label every score is 0; repeated rows are scored each;
further columns pass through, but columns named ``score`` or ``evidence``, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, portions, scratch, slices, table
from .pieces import forget, loaded, store

SAMPLE, FLOOR = 6000, 0.01
#: What a prefix needs to be a feature; words need nothing.
CHI2, LEAST_DF = 25.0, 3
K, BLOCK, SOFT, PRIOR = 15, 128, 0.05, 1.0
#: Blocks of a search's first groups; the last group is all that remain.
WAVES = (4,)
#: Features that are held as rows of a matrix: the share of examples that have one, and how many at most.
COMMON, DENSE = 0.05, 1024
#: How far a score in single precision may be off, as a share of it: no term is below 0.
OFF = (DENSE + 8) * 2.0**-24
#: Postings that are read together, unless one text alone has more.
POSTINGS = 1 << 20
#: Bytes of text that are hashed together, unless one word alone is longer.
CHUNK = 1 << 20
#: Score from which a text counts as toxic.
TOXIC = 0.3
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PREFIXES = (4, 5, 6)


def words(text: str) -> list[str]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).decode("utf-8", "surrogatepass").split()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _bytes(text: str | None) -> bytes:
    """A text's words, parted by spaces."""
    text = (text or "").lower()
    # Spaces beyond ASCII part words, too.
    return (text if text.isascii() else " ".join(text.split())).encode("utf-8", "surrogatepass").translate(_SPLIT)


#: An odd number that leaves 3 when divided by 4.
_BASE = 0x9E3779B97F4A7C17


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``_BASE`` and of its inverse, modulo 2^64."""
    factors = [np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for f in factors:
        f[0] = 1
    return tuple(np.cumprod(f, dtype=np.uint64) for f in factors)


class Hashes:
    """Hashes of the parts of a row of bytes: sums of a random number for each byte times a power of its place in the part."""

    def __init__(self, text: np.ndarray, values: np.ndarray):
        powers, self.inverse = _powers(1 << (max(CHUNK, len(text)) - 1).bit_length())
        self.upto = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(values[text] * powers[: len(text)], out=self.upto[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.upto[ends] - self.upto[starts]) * self.inverse[starts]


def _edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a row of bytes that ends in a space begin and end."""
    edges = np.flatnonzero(np.diff((text != 32).view(np.int8), prepend=0))
    return edges[::2], edges[1::2]


class Vocabulary:
    """Feature ids of words."""

    def __init__(self, names: list[str]):
        self.size = len(names)
        ids = {f: k for k, f in enumerate(names)}
        own = [f for f in names if not f.endswith("*")]
        prefixes = [f for f in names if f.endswith("*")]
        for seed in range(100):
            self.values = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
            hashed, begun = self._hashes(own), self._hashes([f[:-1] for f in prefixes])
            if len(np.unique(hashed)) == len(own) and len(np.unique(begun)) == len(prefixes):
                break
        else:
            raise ValueError("words of the vocabulary can't be told apart")
        order = np.argsort(hashed)
        self.hash = hashed[order]
        # The features of each word, by its place in ``hash``.
        found, ends = array("q"), array("q", [0])
        for k in order.tolist():
            found.extend(ids[f] for f in features_of(own[k]) if f in ids)
            ends.append(len(found))
        self.first, self.features = (np.frombuffer(x, np.int64).copy() if len(x) else np.zeros(0, np.int64) for x in (ends, found))
        order = np.argsort(begun)
        self.begun, self.prefix = begun[order], np.array([ids[prefixes[k]] for k in order.tolist()], np.int64)

    def _hashes(self, names: list[str]) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for at in range(0, len(names), 20_000):
            text = np.frombuffer("".join(f"{f} " for f in names[at : at + 20_000]).encode("utf-8", "surrogatepass"), np.uint8)
            found.append(Hashes(text, self.values).of(*_edges(text)))
        return np.concatenate(found)

    @staticmethod
    def _find(among: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in a sorted row of them, and whether they are there."""
        if not len(among):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
        return at, among[at] == hashes

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, occurrences) of the features of each text, by text and feature."""
        each = [_bytes(t) for t in texts]
        data = b" ".join(each) + b" "
        begins = np.cumsum([0] + [len(t) + 1 for t in each[:-1]])
        keys, at = [np.zeros(0, np.int64)], 0
        while at < len(data):
            to = (data.rfind(b" ", at, at + CHUNK) if at + CHUNK < len(data) else len(data) - 1) + 1 or data.find(b" ", at + CHUNK) + 1
            own = np.frombuffer(data, np.uint8, to - at, at)
            starts, ends = _edges(own)
            hashes = Hashes(own, self.values)
            owner = (np.searchsorted(begins, starts + at, "right") - 1) * self.size
            place, known = self._find(self.hash, hashes.of(starts, ends))
            place = place[known]
            sizes = self.first[place + 1] - self.first[place]
            keys.append(np.repeat(owner[known], sizes) + self.features[_ranges(self.first[place], sizes)])
            if len(self.begun) and not known.all():
                starts, ends, owner = starts[~known], ends[~known], owner[~known]
                leads = (own & 0xC0) != 0x80
                letter, places = np.cumsum(leads) - 1, np.flatnonzero(leads)
                for n in PREFIXES:
                    longer = letter[ends] - letter[starts] > n
                    from_ = starts[longer]
                    place, there = self._find(self.begun, hashes.of(from_, places[letter[from_] + n]))
                    keys.append(owner[longer][there] + self.prefix[place[there]])
            at = to
        key = np.concatenate(keys)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first] // max(1, self.size), key[first] % max(1, self.size), np.diff(first, append=len(key))


class Examples:
    """A block-max inverted index over labelled unit vectors; rows with equal vectors are one example."""

    def __init__(self, weight: np.ndarray, vectors: list, labels: list[int], ids: list[int]):
        """``vectors``: (feature, occurrences) pairs of each row, by feature."""
        self.weight = weight
        place = np.empty(len(weight), ">u4")
        place[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
        kept: dict[tuple[bytes, bytes], list[int]] = {}
        for k, v in enumerate(vectors):
            fs, n = np.array(v, np.int64).reshape(-1, 2).T
            by = np.argsort(place[fs])
            kept.setdefault((place[fs[by]].tobytes(), n[by].astype(">u4").tobytes()), []).append(k)
        # Examples with the same leading features stand together, so blocks have tight bounds.
        order = [kept[v] for v in sorted(kept)]
        del kept
        #: The example of each row.
        self.rank = np.zeros(len(vectors), np.int64)
        for r, own in enumerate(order):
            self.rank[own] = r
        #: (doc_id, label) of the rows of each example; numbers of its rows and of those with label 1.
        self.rows = [sorted((ids[k], labels[k]) for k in own) for own in order]
        self.size = np.array([len(own) for own in self.rows], np.float64)
        self.hits = np.array([sum(y for _, y in own) for own in self.rows], np.float64)
        self.n_blocks = -(-len(order) // BLOCK)
        lengths = [len(vectors[own[0]]) for own in order]
        row = np.repeat(np.arange(len(order), dtype=np.int32), lengths)
        # Laid one after the other into arrays of the whole size.
        feature, share, at = np.zeros(len(row), np.int32), np.zeros(len(row)), 0
        for own, n in zip(order, lengths):
            feature[at : at + n], share[at : at + n] = self.unit(vectors[own[0]])
            at += n
        # Common features: their places in the matrices of blocks, -1 for others.
        spread = np.bincount(feature, minlength=len(weight))
        common = np.flatnonzero(spread >= max(1, COMMON * len(order)))
        common = np.sort(common[np.argsort(-spread[common], kind="stable")][:DENSE])
        self.column = np.full(len(weight), -1, np.int32)
        self.column[common] = np.arange(len(common))
        own = self.column[feature] >= 0
        #: The shares of common features by example, and the largest by feature and block.
        self.dense = np.zeros((self.n_blocks * BLOCK, len(common)))
        self.dense[row[own], self.column[feature[own]]] = share[own]
        self.dense_top = self.dense.reshape(self.n_blocks, BLOCK, len(common)).max(axis=1, initial=0).T
        feature, row, share = feature[~own], row[~own], share[~own]
        by = np.lexsort((row, feature))
        #: Postings of the other features by feature and example.
        self.row, self.share, feature = row[by], share[by], feature[by]
        del row, share, by
        # A segment holds the postings of one feature in one block.
        key = feature.astype(np.int64) * max(1, self.n_blocks) + self.row // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.start, self.length = first.astype(np.int32), np.diff(first, append=len(key)).astype(np.int32)
        del key
        self.block = (self.row[first] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0)
        #: Postings and segments of each feature, as bounds.
        every = np.arange(len(weight) + 1, dtype=np.int32)
        self.postings, self.segments = np.searchsorted(feature, every), np.searchsorted(feature[first], every)

    @cached_property
    def matrices(self) -> np.ndarray:
        """The shares of common features by block, feature and example of the block, in single precision."""
        return np.ascontiguousarray(self.dense.reshape(self.n_blocks, BLOCK, self.dense.shape[1]).transpose(0, 2, 1), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "matrices"}

    def unit(self, counts) -> tuple[np.ndarray, np.ndarray]:
        fs, n = np.array(counts, np.int64).reshape(-1, 2).T
        w = (1 + np.log(n)) * self.weight[fs]
        return fs, w / max(math.sqrt(float(w @ w)), 1e-12)

    def nearest(self, counts, k: int, without: int | None = None) -> list[tuple[int, float]]:
        """As ``nearest_of_all`` for one query."""
        fs, n = np.array(counts, np.int64).reshape(-1, 2).T
        return self.nearest_of_all(np.zeros(len(fs), np.int64), fs, n, 1, k, None if without is None else [without])[0]

    def nearest_of_all(self, query: np.ndarray, fs: np.ndarray, n: np.ndarray, queries: int, k: int, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """For each of the queries, given as rows (query, feature, occurrences) by query: (rank, cosine) of the examples of
        largest cosine above 0 that have k rows, and of all that tie with the last; ``without`` leaves out one row of an example of each."""
        if not len(self.rows):
            return [[] for _ in range(queries)]
        q = (1 + np.log(n)) * self.weight[fs]
        q /= np.maximum(np.sqrt(np.bincount(query, q * q, queries)), 1e-12)[query]
        upto = np.concatenate([[0], np.cumsum(np.bincount(query, self.postings[fs + 1] - self.postings[fs] + 1, queries))])
        bounds = np.searchsorted(query, np.arange(queries + 1))
        # About as many cells of scores as postings.
        together = max(1, POSTINGS // (BLOCK * self.n_blocks))
        out, at = [], 0
        while at < queries:
            to = min(at + together, max(at + 1, int(np.searchsorted(upto, upto[at] + POSTINGS, "right")) - 1), queries)
            own = slice(bounds[at], bounds[to])
            out += self._nearest(query[own] - at, fs[own], q[own], to - at, k, without and without[at:to])
            at = to
        return out

    def _nearest(self, query: np.ndarray, fs: np.ndarray, q: np.ndarray, queries: int, k: int, without: list[int] | None) -> list[list[tuple[int, float]]]:
        width, n_rows = BLOCK * self.n_blocks, len(self.rows)
        common = self.column[fs] >= 0
        dense = np.zeros((queries, self.dense.shape[1]))
        dense[query[common], self.column[fs[common]]] = q[common]
        single = dense.astype(np.float32)
        query, fs, q = query[~common], fs[~common], q[~common]
        sizes = self.segments[fs + 1] - self.segments[fs]
        segments, query, q = _ranges(self.segments[fs], sizes), np.repeat(query, sizes), np.repeat(q, sizes)
        block = self.block[segments]
        bounds = dense @ self.dense_top + np.bincount(query * self.n_blocks + block, q * self.top[segments], queries * self.n_blocks).reshape(queries, -1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(self.n_blocks)[None, :], 1)
        # By lists, exact; by lists and matrices.
        listed, scores = np.zeros((queries, width)), np.zeros((queries, width), np.float32)
        # One row of an example may be left out, so one example more may be needed.
        most = min(n_rows, k + (without is not None))
        least, done = np.zeros(queries), 0
        for wave in (*WAVES, self.n_blocks):
            chosen = (place >= done) & (place < done + wave) & (bounds > 0) & (bounds + 1e-9 >= least[:, None] * (1 - 3 * OFF))
            done += wave
            if not chosen.any():
                continue
            for b in np.flatnonzero(chosen.any(axis=0)):
                of = np.flatnonzero(chosen[:, b])
                scores[of, b * BLOCK : (b + 1) * BLOCK] = single[of] @ self.matrices[b]
            own = chosen[query, block]
            read = segments[own]
            sizes = self.length[read]
            postings = _ranges(self.start[read], sizes)
            new = np.bincount(np.repeat(query[own] * width, sizes) + self.row[postings], np.repeat(q[own], sizes) * self.share[postings], queries * width).reshape(queries, -1)
            listed += new
            scores += new
            read = scores if done >= self.n_blocks else scores.reshape(queries, -1, BLOCK)[np.arange(queries)[:, None], order[:, :done]].reshape(queries, -1)
            if read.shape[1] >= most:
                least = np.partition(read, -most, axis=1)[:, -most].astype(np.float64)
        out = []
        for d in range(queries):
            best = np.flatnonzero((scores[d] >= least[d] * (1 - 3 * OFF) - 1e-11) & (scores[d] > 0))
            score = np.round(listed[d, best] + self.dense[best] @ dense[d], 12)
            best, score = best[score > 0], score[score > 0]
            by = np.lexsort((best, -score))
            best, score = best[by], score[by]
            size = self.size[best] - (best == without[d]) if without else self.size[best]
            full = np.flatnonzero(np.cumsum(size) >= k)
            near = (size > 0) & (score >= (score[full[0]] if len(full) else 0))
            out.append(list(zip(best[near].tolist(), score[near].tolist())))
        return out

    def vote(self, near: list[tuple[int, float]], prior: float, without: tuple[int, int] | None = None) -> float:
        """Share of toxic votes; ``without``: rank and label of a row that has none."""
        top = bottom = 0.0
        for r, s in near:
            w = 1 / (1 - min(s, 1.0) + SOFT)
            n, hits = self.size[r], self.hits[r]
            if without and r == without[0]:
                n, hits = n - 1, hits - without[1]
            top, bottom = top + w * hits, bottom + w * n
        # A prior vote weighs as much as a row at distance 1.
        return float((top + PRIOR / (1 + SOFT) * prior) / (bottom + PRIOR / (1 + SOFT)))


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (lower edges, values) of the non-decreasing least-squares fit."""
    edges, first, inverse = np.unique(votes, return_index=True, return_inverse=True)
    blocks: list[list[float]] = []
    for e, n, s in zip(edges, np.bincount(inverse), np.bincount(inverse, labels)):
        blocks.append([e, float(n), float(s)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    # Shrunk a little, so that no step says 0 or 1.
    rate = float(labels.mean()) if len(labels) else 0.0
    values = np.array([(b[2] + rate) / (b[1] + 1) for b in blocks])
    return np.array([b[0] for b in blocks]), np.maximum.accumulate(values)


class Model:
    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, rows: list[tuple[int, int, np.ndarray]]):
        self.vocabulary = vocabulary
        plain = [y for _, y, v in rows if not len(v)]
        self.prior = (sum(plain) + sum(y for _, y, _ in rows) / max(1, len(rows))) / (len(plain) + 1)
        own = [r for r in rows if len(r[2])]
        self.examples = Examples(weight, [v for _, _, v in own], [y for _, y, _ in own], [i for i, _, _ in own])
        # The rows' examples are needed here alone.
        at = self.examples.__dict__.pop("rank").tolist()
        votes = []
        for k in range(0, len(own), 500):
            part = own[k : k + 500]
            fs, n = np.concatenate([v for _, _, v in part]).astype(np.int64).T
            query = np.repeat(np.arange(len(part)), [len(v) for _, _, v in part])
            near = self.examples.nearest_of_all(query, fs, n, len(part), K, at[k : k + 500])
            votes += [self.examples.vote(s, self.prior, (r, y)) for s, r, (_, y, _) in zip(near, at[k:], part)]
        self.examples.__dict__.pop("matrices", None)
        self.edges, self.values = isotonic(np.array(votes), np.array([y for _, y, _ in own], np.float64))
        self.seen: dict[bytes, tuple] = {}

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """Calibrated scores, and the evidence: (doc_id, cosine, label) of the nearest K rows, ties by the vector and the id."""
        # Copies of a text are scored once, as long as it is remembered.
        digests = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.seen) >= 5_000:
            self.seen.clear()
        new = {d: t for d, t in zip(digests, texts) if d not in self.seen}
        query, fs, n = self.vocabulary.counts(list(new.values()))
        some = np.bincount(query, minlength=len(new)) > 0
        near = self.examples.nearest_of_all(query, fs, n, len(new), K)
        for d, any_, found in zip(new, some.tolist(), near):
            self.seen[d] = self._scored(found) if any_ else (self.prior, [])
        return [self.seen[d] for d in digests]

    def _scored(self, near: list[tuple[int, float]]) -> tuple[float, list[tuple[int, float, int]]]:
        vote = self.examples.vote(near, self.prior)
        at = int(np.searchsorted(self.edges, vote, "right")) - 1
        value = float(self.values[max(at, 0)]) if len(self.values) else self.prior
        return value, [(i, s, y) for r, s in near for i, y in self.examples.rows[r]][:K]


def held_out():
    """A row's part: remainder 2 of the id's crc32 is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Fitted(NamedTuple):
    """A ``Model`` in a file that tasks read, and the few numbers of it that the driver knows: its rate and its steps."""

    file: str
    prior: float
    edges: np.ndarray
    values: np.ndarray


def _made(rows: DataFrame, make: Callable[[pa.Table], object], name: str, *also: str) -> tuple[str, list[np.ndarray]]:
    """The file in the shared folder that holds what one task makes of all the rows: few, whatever the input, and one of nulls
    besides, so that there is a task. Of that the driver learns the attributes ``also`` alone, numbers or short rows of them."""
    spark = rows.sparkSession
    folder = scratch(spark, name)

    def run(batches: Iterator[pa.RecordBatch]):
        made = make(pa.Table.from_batches(batches))
        few = [np.atleast_1d(getattr(made, a)).astype(np.float64).tolist() for a in also]
        yield pa.RecordBatch.from_arrays([pa.array([store(made, folder)]), pa.array([few], pa.list_(pa.list_(pa.float64())))], ["file", "few"])

    none = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    file, few = rows.unionByName(none).repartition(1).mapInArrow(run, "file string, few array<array<double>>").first()
    return file, [np.array(x, np.float64) for x in few]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    own = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids and labels: a bounded broadcast. Of repeated ids one text is learned from.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = materialise(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxic-sample")
    n, positive = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in slices(batches):
            both, hits = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs = {f for w in set(words(t)) for f in features_of(w)}
                both.update(fs)
                if y:
                    hits.update(fs)
            yield pa.RecordBatch.from_pydict({"feature": list(both), "n": list(both.values()), "hits": [hits[f] for f in both]}, pa.schema([("feature", pa.string()), ("n", pa.int64()), ("hits", pa.int64())]))

    table_ = texts.select("text", "toxic").mapInArrow(count, "feature string, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    a, b = F.col("hits").cast("double"), (F.col("n") - F.col("hits")).cast("double")
    c, d = positive - a, (n - positive) - b
    chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    told = table_.withColumn("chi2", F.when((F.col("n") < n) & F.lit(0 < positive < n), chi2)).filter(~F.col("feature").endswith("*") | ((F.col("n") >= LEAST_DF) & (F.col("chi2") >= CHI2)))
    weights = told.select("feature", F.greatest(F.lit(FLOOR), F.sqrt(F.col("chi2") / n)).alias("r"))

    def vocabulary(rows: pa.Table) -> tuple[Vocabulary, np.ndarray]:
        rows = rows.filter(rows["feature"].is_valid()).sort_by("feature")
        return Vocabulary(rows["feature"].to_pylist()), rows["r"].to_numpy()

    # All words of at most ``sample`` rows.
    told_words, _ = _made(weights, vocabulary, "toxic-vocabulary")

    def document_frequencies(batches: Iterator[pa.RecordBatch]):
        own, _ = loaded(told_words)
        found = np.zeros(own.size + 1, np.int64)
        for b in portions(batches, 0):
            found[-1] += b.num_rows
            found[:-1] += np.bincount(own.counts(b.column(0).to_pylist())[1], minlength=own.size)
        some = np.flatnonzero(found)
        for at in range(0, len(some), 10_000):
            part = some[at : at + 10_000]
            yield pa.RecordBatch.from_pydict({"f": part.astype(np.int32), "n": found[part]})

    spread = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(document_frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))

    def vectors(batches: Iterator[pa.RecordBatch]):
        own, _ = loaded(told_words)
        for b in portions(batches, 1):
            query, fs, n = own.counts(b.column(1).to_pylist())
            ends = pa.array(np.searchsorted(query, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (fs, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], ["doc_id", "toxic", "fs", "k"])

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, fs array<int>, k array<int>")

    def model(both: pa.Table) -> Model:
        own, r = loaded(told_words)
        counted, both = both.filter(both["f"].is_valid()), both.filter(both["doc_id"].is_valid())
        df = np.zeros(own.size + 1)
        df[counted["f"].to_numpy()] = counted["n"].to_numpy()
        idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
        found = []
        for b in both.to_batches():
            ends = b["fs"].offsets.to_numpy()
            pairs = np.stack([b[c].values.to_numpy() for c in ("fs", "k")], 1)
            found += [(i, y, pairs[p:q].copy()) for i, y, p, q in zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), ends, ends[1:])]
        found.sort(key=lambda x: x[0])
        return Model(own, idf * r, found)

    # At most ``sample`` rows, and a number for each of their words.
    file, (prior, edges, values) = _made(rows.unionByName(spread, allowMissingColumns=True), model, "toxic-model", "prior", "edges", "values")
    return Fitted(file, float(prior[0]), edges, values)


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def scores(docs: DataFrame, model: Fitted, evidence: bool = True) -> DataFrame:
    """Add ``score`` double and, with ``evidence``, the nearest examples."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "evidence")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())] + [T.StructField("evidence", EVIDENCE)] * evidence)
    at = [f.name for f in kept].index("text")
    arrow = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
    file = model.file

    def run(batches: Iterator[pa.RecordBatch]):
        own = loaded(file)
        for b in portions(batches, at, 500):
            found = own.score(b.column(at).to_pylist())
            new = [pa.array([s for s, _ in found], pa.float64())]
            if evidence:
                new.append(pa.array([[{"doc_id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found], arrow))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [f.name for f in schema.fields])
        # The model stays with the worker; what it has scored need not.
        own.seen.clear()

    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), F.slice("evidence", 1, 3).alias("evidence"))
