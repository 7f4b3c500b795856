"""Collocations: phrases of two to five words that stand together far more often than their parts would by chance, by language.

A phrase's score is its lowest over all cuts of floor(1000 a n / (l r)), where a, l and r count the phrase and both parts.
As r >= a, the score of every phrase that begins with a prefix of count l is at most floor(1000 n / l), and of the prefixes of a phrase
the first word has the largest count. So phrases are grown from first words by falling bound: a part of them first, which gives a score that the
2,000th phrase reaches, then those whose bound reaches that score (or all, where there is no 2,000th), until no bound left does. A tie with the 2,000th could still
matter, so a bound that equals it is expanded.

What is grown from is small: a pass counts the words, a second one finds the pairs of words that may be frequent, by counts of 40-bit hashes in buckets, and
a third one writes what is left of the texts, runs of words whose neighbours make such pairs, equal runs once with their number. Every
phrase that is frequent lies within runs whole. Filters are bitmaps of fixed size; where the input outgrows them they let more through, and counts stay exact.

A frequent phrase lies in a longer one of the same count exactly when the same word always stands before it, or after it; so the least and the
greatest hash of its neighbours decide that, and no pair of phrases is compared.

Words are 64-bit hashes of language and word. That no two words share one is checked, all words of all documents over; otherwise the job fails and another ``seed`` is to be given.

Defined cases: a null text is empty, a null language is ``und``; A-Z become lower case, texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and words are
``[^\\x20\\x09]+``; repeated rows count each; an empty table gives no rows; further columns, ids among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, portions, table

LONGEST, LEAST, BEST = 5, 100, 2000
#: Bits of the filters of words (half a megabyte) and of pairs of words (16 megabytes).
WORD_BITS, PAIR_BITS = 22, 27
#: Pairs, words or runs that a task gathers before it passes their counts on.
GATHERED = 1 << 21
#: Share of the occurrences of frequent words whose phrases are grown first; the rarest words' ones.
FIRST = 0.25
#: Times as frequent as before are the words that come next, where a language has no last score yet.
STEP = 16

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_FOLD = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c in (9, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
W = [f"w{i}" for i in range(1, LONGEST + 1)]


# -- words as numbers ----------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _C
    h = (h ^ h >> np.uint64(29)) * _B
    return h ^ h >> np.uint64(32)


@lru_cache(maxsize=1)
def _tables(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A number for each byte, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 62, dtype=np.int64)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _upto(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of values[j] * base^j over all j before each place, modulo 2^64."""
    size = 1 << max(10, int(len(values)).bit_length())
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(int(base), size)[: len(values)])])


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each span of ``values``, the same wherever it stands."""
    _, base, inverse = _tables(seed)
    sums = _upto(values, base)
    size = 1 << max(10, int(len(values)).bit_length())
    return _mixed((sums[ends] - sums[starts]) * _powers(int(inverse), size)[starts] + (ends - starts).astype(np.uint64) * _A)


def words(texts: list[bytes], langs: list[str], seed: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, keys, row) of all words of the texts; and whether the next word follows in the same piece, as the sixth."""
    folded = b"\n".join(texts).translate(_FOLD)
    arr = np.frombuffer(folded, np.uint8)
    inside = np.zeros(len(arr) + 2, np.int8)
    inside[1:-1] = (arr != 32) & (arr != 10)
    turns = np.diff(inside)
    starts, ends = np.nonzero(turns == 1)[0], np.nonzero(turns == -1)[0]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    row = np.searchsorted(begins, starts, "right") - 1
    h = _spans(_tables(seed)[0][arr], starts, ends, seed) if len(starts) else np.zeros(0, np.uint64)
    of_lang = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in langs], np.uint64)
    keys = _mixed(h + of_lang[row] * _A) if len(starts) else h
    keys[keys == 0] = 1
    piece = np.cumsum(arr == 10)[starts] if len(starts) else starts
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return folded, starts, ends, keys, row, joined


def _pairs(keys: np.ndarray) -> np.ndarray:
    """A hash of each word with the one after it."""
    return _mixed(keys[:-1] * _A + keys[1:])


def _has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _cell(keys: np.ndarray, n_bits: int) -> np.ndarray:
    return keys & np.uint64((1 << n_bits) - 1)


def bitmap(cells: DataFrame, n_bits: int) -> np.ndarray:
    """The bits that the column ``cell`` names: 2^n_bits of them, whatever the rows."""
    chunk = F.floor(F.col("cell") / 32768)
    found = cells.groupBy(chunk.alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") % 32768 + 1)).alias("bits")).collect()
    out = np.zeros((1 << n_bits) // 8, np.uint8)
    for r in found:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["chunk"] * 4096 : r["chunk"] * 4096 + len(own)] = own[: len(out) - r["chunk"] * 4096]
    return out


def _cells_of(col: str, n_bits: int) -> Column:
    return F.col(col).bitwiseAND(F.lit((1 << n_bits) - 1).cast("long")).alias("cell")


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], seed: int):
    for b in portions(batches, 0):
        yield b, words([bytes(t or b"") for t in b.column(0).to_pylist()], b.column(1).to_pylist(), seed)


# -- passes over the texts ------------------------------------------------------------------------


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, key, f) of every word; fails where two words have one key."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def give(found: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(zip(*found.values()), list(schema)[1:]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        found: dict[int, list] = {}
        for b, (folded, starts, ends, keys, row, _) in _texts(batches, seed):
            langs = b.column(1).to_pylist()
            own, first, many = np.unique(keys, return_index=True, return_counts=True)
            for k, s, e, r, n in zip(_signed(own).tolist(), starts[first].tolist(), ends[first].tolist(), row[first].tolist(), many.tolist()):
                if (known := found.get(k)) is not None:
                    known[2] += n
                else:
                    found[k] = [langs[r], folded[s:e].decode(), n]
            if len(found) > GATHERED // 4:
                yield give(found)
                found = {}
        if found:
            yield give(found)

    counted = docs.mapInArrow(run, "key long, lang string, word string, f long")
    same = F.assert_true((F.min("lang") == F.max("lang")) & (F.min("word") == F.max("word")), F.lit("two words share a hash: give another seed"))
    merged = counted.groupBy("key").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("f").alias("f"), same.alias("_same"))
    return materialise(merged.filter(F.col("_same").isNull()).drop("_same"), "words")


def frequent_pairs(docs: DataFrame, word_bits: np.ndarray, seed: int, least: int) -> np.ndarray:
    """Filter of the pairs of frequent words whose folded hashes are counted ``least`` times or more."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    known = spark.sparkContext.broadcast(word_bits)
    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def give(gathered: list[np.ndarray]):
        own, many = np.unique(np.concatenate(gathered), return_counts=True)
        # The top bits choose the bucket, so each has a stretch of the sorted hashes.
        bucket = ((own >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        low = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(k, low[ends[k] : ends[k + 1]].tobytes(), (many[ends[k] : ends[k + 1]]).astype("<u4" if many[ends[k] : ends[k + 1]].max() > 255 else np.uint8).tobytes()) for k in range(buckets) if ends[k] < ends[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        gathered, size = [], 0
        for _, (_, _, _, keys, _, joined) in _texts(batches, seed):
            if len(keys) < 2:
                continue
            good = _has(known.value, _cell(keys, WORD_BITS))
            h = _pairs(keys)[good[:-1] & good[1:] & joined[:-1]]
            if len(h):
                gathered.append(h)
                size += len(h)
            if size > GATHERED:
                yield give(gathered)
                gathered, size = [], 0
        if size:
            yield give(gathered)

    def often(batches: Iterator[pa.RecordBatch]):
        hashes, counts = [], []
        for b in batches:
            for h, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                wide = np.zeros((len(h) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(h, np.uint8).reshape(-1, 5)
                hashes.append(wide.reshape(-1).view("<u8"))
                counts.append(np.frombuffer(c, np.uint8 if len(c) == len(wide) else "<u4").astype(np.int64))
        if not hashes:
            return
        h, c = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        at = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0]
        cells = _cell(h[at][np.add.reduceat(c, at) >= least], PAIR_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(cells))], names=["cell"])

    counted = docs.mapInArrow(run, "bucket int, hashes binary, counts binary").repartitionById(buckets, F.col("bucket")).mapInArrow(often, "cell long")
    return bitmap(counted, PAIR_BITS)


def runs(docs: DataFrame, word_bits: np.ndarray, pair_bits: np.ndarray, seed: int) -> DataFrame:
    """(run, times): longest rows of words, as keys, whose neighbours all make pairs that may be frequent."""
    known = docs.sparkSession.sparkContext.broadcast((word_bits, pair_bits))
    schema = pa.schema([("run", pa.list_(pa.int64())), ("times", pa.int64())])

    def give(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        size = ends - starts
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = keys[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(flat))), pa.array(times, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        words_in, pairs_in = known.value
        kept, size = [], 0

        def distinct():
            keys = np.concatenate([k for k, _ in kept])
            lengths = np.concatenate([n for _, n in kept])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            _, first, many = np.unique(_spans(keys, starts, ends, seed), return_index=True, return_counts=True)
            return give(keys, starts[first], ends[first], many)

        for _, (_, _, _, keys, _, joined) in _texts(batches, seed):
            if len(keys) < 2:
                continue
            good = _has(words_in, _cell(keys, WORD_BITS))
            link = good[:-1] & good[1:] & joined[:-1]
            at = np.nonzero(link)[0]
            link[at] = _has(pairs_in, _cell(_pairs(keys)[at], PAIR_BITS))
            turns = np.diff(np.r_[0, link.astype(np.int8), 0])
            starts, ends = np.nonzero(turns == 1)[0], np.nonzero(turns == -1)[0] + 1
            if len(starts):
                inside = np.zeros(len(keys) + 1, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                own = keys[np.cumsum(inside[:-1]).astype(bool)]
                kept.append((own, ends - starts))
                size += len(own)
            if size > GATHERED:
                yield distinct()
                kept, size = [], 0
        if size:
            yield distinct()

    found = docs.mapInArrow(run, "run array<long>, times long")
    return materialise(found.groupBy("run").agg(F.sum("times").alias("times")), "runs")


# -- growth ---------------------------------------------------------------------------------------


def phrases(found: DataFrame, bits: np.ndarray, pairs: bool, least: int) -> DataFrame:
    """(w1 ... w5, f, before, after): phrases of two words or more that are counted ``least`` times, of those whose first word (or pair of
    words) ``bits`` has; 0 stands for no word. before: whether the same word always stands before it; after: likewise."""
    known = found.sparkSession.sparkContext.broadcast(bits)
    names = [*W, "f", "b0", "b1", "a0", "a1"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                runs_, times = part.column(0), part.column(1).to_numpy()
                flat = runs_.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                size = np.diff(runs_.offsets.to_numpy())
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(len(size)), size)
                ends = np.cumsum(size)
                rest = np.repeat(ends, size) - np.arange(len(flat))
                wide = np.concatenate([flat, np.zeros(LONGEST + 1, np.uint64)])
                if pairs:
                    near = np.concatenate([_pairs(flat), np.zeros(1, np.uint64)])
                    first = (rest > 1) & _has(known.value, _cell(near, PAIR_BITS))
                else:
                    first = (rest > 1) & _has(known.value, _cell(flat, WORD_BITS))
                before = np.concatenate([np.zeros(1, np.uint64), flat[:-1]])
                before[ends[:-1]] = 0
                places = np.nonzero(first)[0]
                for n in range(2, LONGEST + 1):
                    p = places[rest[places] >= n]
                    if not len(p):
                        break
                    key = wide[p]
                    for j in range(1, n):
                        key = _mixed(key * _A + wide[p + j])
                    after = np.where(rest[p] > n, wide[p + n], np.uint64(0))
                    order = np.argsort(key, kind="stable")
                    k, p, a, f = key[order], p[order], after[order], times[owner[p[order]]]
                    # Whether phrases are equal is asked of the words, not of the hash.
                    new = np.zeros(len(p), bool)
                    new[0] = True
                    for j in range(n):
                        new[1:] |= wide[p[1:] + j] != wide[p[:-1] + j]
                    at_ = np.nonzero(new)[0]
                    q = p[at_]
                    bf = before[p]
                    cols = [_signed(wide[q + j]) if j < n else np.zeros(len(q), np.int64) for j in range(LONGEST)]
                    cols += [np.add.reduceat(f, at_), *(_signed(g.reduceat(v, at_)) for v in (bf, a) for g in (np.minimum, np.maximum))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    # Least and greatest are of signed numbers in what follows, of unsigned ones before: equal ends mean one value either way.
    parts = found.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    counted = parts.groupBy(*W).agg(F.sum("f").alias("f"), *[F.min(F.least(f"{x}0", f"{x}1")).alias(f"{x}0") for x in "ba"], *[F.max(F.greatest(f"{x}0", f"{x}1")).alias(f"{x}1") for x in "ba"], *[F.max((F.col(f"{x}0") == 0).cast("int")).alias(f"{x}n") for x in "ba"])
    always = lambda x: (F.col(f"{x}0") == F.col(f"{x}1")) & (F.col(f"{x}n") == 0)
    return counted.filter(F.col("f") >= least).select(*W, "f", always("b").alias("before"), always("a").alias("after"))


def _n_words() -> Column:
    return sum((F.col(w) != 0).cast("int") for w in W)


def _cut(row: str, start: Column, size: Column) -> list[Column]:
    """Words ``start`` (from 1) on, ``size`` of them, of the array ``row``; 0 after them."""
    return [F.when(F.lit(i) <= size, F.get(F.col(row), start + i - 2)).otherwise(F.lit(0)).cast("long") for i in range(1, LONGEST + 1)]


def scored(candidates: DataFrame, counts: DataFrame, words_: DataFrame) -> DataFrame:
    """The candidates (w1 ..., f as a) with l, r, n and the score of their lowest cut (ties: the shortest first part), by exact decimals."""
    row = candidates.withColumn("ws", F.array(*W)).withColumn("m", _n_words())
    cuts = row.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("*", *[c.alias(f"l{i}") for i, c in enumerate(_cut("ws", F.lit(1), F.col("k")), 1)], *[c.alias(f"r{i}") for i, c in enumerate(_cut("ws", F.col("k") + 1, F.col("m") - F.col("k")), 1)])
    sizes = counts.select(*W, "f").unionByName(words_.select(F.col("key").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in W[1:]], "f"))
    part = lambda s: sizes.select(*[F.col(w).alias(f"{s}{w[1:]}") for w in W], F.col("f").alias(s))
    cuts = cuts.join(part("l"), [f"l{w[1:]}" for w in W]).join(part("r"), [f"r{w[1:]}" for w in W])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(words_.select(F.col("key").alias("w1"), "lang", "n", F.col("f").alias("first_f")), "w1")
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (F.col("f").cast("decimal(15,0)") * big("n")), big("l") * big("r")))
    best = F.min_by(F.struct("l", "r"), F.struct("score", "k"))
    keys = [*W, "lang", "n", "f", "first_f", "before", "after", "m"]
    return cuts.groupBy(*keys).agg(F.min("score").alias("score"), best.alias("b")).select(*keys, "score", "b.l", "b.r")


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, seed: int = 0) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``best`` phrases of (lang, text)."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    out = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    every = word_counts(own, seed)
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = every.filter(F.col("f") >= least).join(totals, "lang")
    # How far growth begins: the rarest words of a language that have a share of all occurrences, by counts rounded to powers of two.
    size = F.floor(F.log2("f"))
    sizes = frequent.groupBy("lang", size.alias("size")).agg(F.sum("f").alias("occ"))
    w = Window.partitionBy("lang")
    upto = sizes.withColumn("part", F.sum("occ").over(w.orderBy("size")) / F.sum("occ").over(w))
    begin = upto.groupBy("lang").agg(F.max(F.when(F.col("part") <= FIRST, F.col("size"))).alias("size"), F.min("size").alias("least"), F.max("size").alias("most"))
    begin = begin.select("lang", F.pow(F.lit(2.0), F.coalesce("size", "least") + 1).cast("long").alias("reach"), F.pow(F.lit(2.0), F.col("most") + 1).cast("long").alias("top"))
    words_ = materialise(frequent.join(begin, "lang"), "frequent-words")
    if words_.isEmpty():
        return spark.createDataFrame([], out)
    word_bits = bitmap(words_.select(_cells_of("key", WORD_BITS)), WORD_BITS)
    found = runs(own, word_bits, frequent_pairs(own, word_bits, seed, least), seed)
    # (lang, done, reach): first words counted up to ``done`` times are expanded, those up to ``reach`` are next.
    state = materialise(words_.groupBy("lang").agg(F.lit(0).cast("long").alias("done"), F.first("reach").alias("reach"), F.first("top").alias("top"), F.first("n").alias("n")), "frontier")
    counts = results = None
    while True:
        new = words_.drop("reach", "top", "n").join(state, "lang").filter((F.col("f") > F.col("done")) & (F.col("f") <= F.col("reach")))
        bits = bitmap(new.select(_cells_of("key", WORD_BITS)), WORD_BITS)
        grown = phrases(found, bits, False, least).join(new.select(F.col("key").alias("w1")), "w1")
        fresh = materialise(grown, "phrases")
        counts = fresh if counts is None else counts.unionByName(fresh)
        # Parts that begin with a word not expanded yet are counted by themselves.
        tails = fresh.withColumn("ws", F.array(*W)).withColumn("m", _n_words()).filter("m > 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 2)))
        tails = tails.select(*[c.alias(W[i]) for i, c in enumerate(_cut("ws", F.col("k") + 1, F.col("m") - F.col("k")))]).distinct()
        later = words_.drop("reach", "top", "n").join(state.select("lang", "reach"), "lang").filter(F.col("f") > F.col("reach")).select(F.col("key").alias("w1"))
        tails = materialise(tails.join(later, "w1", "left_semi"), "tails")
        rest = counts
        if not tails.isEmpty():
            bits = bitmap(_pair_cells(tails), PAIR_BITS)
            rest = counts.unionByName(materialise(phrases(found, bits, True, least).join(tails, W, "left_semi"), "tail-counts"))
        open_ = ~(F.col("before") | F.col("after")) | (_n_words() == LONGEST)
        marked = scored(fresh.filter(open_), rest, words_)
        marked = materialise(marked, "scored")
        results = marked if results is None else results.unionByName(marked)
        by_score = Window.partitionBy("lang").orderBy(F.col("score").desc())
        last = results.withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= best).groupBy("lang").agg(F.when(F.count(F.lit(1)) == best, F.min("score")).alias("last"))
        # Bounds of words counted up to n * 1000 / last reach the last score.
        need = F.coalesce(F.least(F.floor(F.col("n") * F.lit(1000).cast("decimal(4,0)") / F.greatest(F.col("last"), F.lit(1))).cast("decimal(38,0)"), F.col("top").cast("decimal(38,0)")).cast("long"), F.col("top"))
        ahead = state.join(last, "lang", "left").select("lang", F.col("reach").alias("done"), F.least(need, F.when(F.col("last").isNull(), F.col("reach") * STEP).otherwise(F.col("top")), F.col("top")).alias("reach"), "top", "n")
        state = materialise(ahead.select("lang", "done", F.greatest("done", "reach").alias("reach"), "top", "n"), "frontier")
        if state.filter(F.col("reach") > F.col("done")).isEmpty():
            break
    high = results.join(last, "lang", "left").filter(F.coalesce(F.col("score") >= F.col("last"), F.lit(True)))
    high = high.select("*", F.xxhash64(*W).alias("_id"))
    parts = high.select("_id", *W, F.posexplode(F.filter(F.array(*W), lambda c: c != 0)).alias("at", "key")).join(words_.select("key", "word"), "key")
    spelt = parts.groupBy(*W).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    ranked = high.join(spelt, W).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= best).select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _pair_cells(rows: DataFrame) -> DataFrame:
    """Cells of the first two words of each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            first, second = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(_cell(_mixed(first * _A + second), PAIR_BITS)))], names=["cell"])

    return rows.select("w1", "w2").mapInArrow(run, "cell long")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, w[i:i + {n - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})" for n in range(2, LONGEST + 1))
OP13_SQL = rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
ones AS (SELECT lang, [w] AS p, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM pieces) GROUP BY lang, w), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang),
many AS (SELECT lang, p, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, p HAVING count(*) >= {LEAST}), sizes AS (SELECT * FROM ones UNION ALL SELECT * FROM many),
inner_ AS (SELECT lang, p[:-2] AS p, f FROM many WHERE len(p) > 2 UNION ALL SELECT lang, p[2:], f FROM many WHERE len(p) > 2),
kept AS (SELECT * FROM many ANTI JOIN inner_ USING (lang, p, f)),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM kept),
priced AS (SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN sizes x ON x.lang = c.lang AND x.p = c.p[:c.k] JOIN sizes y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(p, ' ') AS phrase FROM best)) WHERE rank <= {BEST}"""
