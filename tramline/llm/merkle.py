"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into sections (after each blank line), sections into paragraphs (at line feeds) and paragraphs into phrases (after
a word whose hash is divisible by ``PHRASE``, so an edit moves no boundary but its own). A phrase's digest is a 128-bit
hash of its text, an inner node's that of its children's digests. So equal roots mean equal texts, and comparing two
trees from the root down meets only branches that differ, which give the edited spans.

A fingerprint is the root in hex, ``:``, and the phrases' 32-bit hashes in order in base64. The likeness of two
fingerprints is the share of phrases that they have in common (as multisets), of the larger one; 1 if the roots are equal.

Defined cases: null is empty; an empty text has one empty phrase; repeated rows are fingerprinted each; a table of one row is its own
neighbour; rows with a null id come before all others in id order (if all are null, the first is its own neighbour); further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_range, partitions, slices, table

#: Mean number of words in a phrase.
PHRASE = 8


def phrases(paragraph: str) -> list[str]:
    """The phrases of a paragraph; joined by spaces they are the paragraph again."""
    words = paragraph.split(" ")
    if len(words) == 1:
        return words
    crc = zlib.crc32
    out, at = [], 0
    for k, w in enumerate(words, 1):
        if crc(w.encode("utf-8", "surrogatepass")) % PHRASE == 0:
            out.append(" ".join(words[at:k]))
            at = k
    if at < len(words):
        out.append(" ".join(words[at:]))
    return out


def _node(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


def tree(text: str) -> tuple[bytes, list]:
    """(root digest, sections); a section is (digest, paragraphs), a paragraph (digest, phrases), a phrase (digest, characters)."""
    leaf = xxhash.xxh3_128_digest
    sections, paragraphs = [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        leaves = [(leaf(p.encode("utf-8", "surrogatepass")), len(p)) for p in phrases(line)]
        paragraphs.append((_node([d for d, _ in leaves]), leaves))
        if k + 1 == len(lines) or not line.strip():
            sections.append((_node([d for d, _ in paragraphs]), paragraphs))
            paragraphs = []
    return _node([d for d, _ in sections]), sections


class Fingerprint:
    """Root and phrase hashes of a text."""

    __slots__ = ("root", "leaves")

    def __init__(self, root: bytes, leaves: np.ndarray):
        self.root, self.leaves = root, leaves

    @classmethod
    def of(cls, text: str) -> "Fingerprint":
        root, sections = tree(text)
        raw = b"".join(d[:4] for _, ps in sections for _, ls in ps for d, _ in ls)
        return cls(root, np.frombuffer(raw, "<u4"))

    @classmethod
    def parse(cls, text: str) -> "Fingerprint":
        root, _, leaves = text.partition(":")
        return cls(bytes.fromhex(root), np.frombuffer(base64.b64decode(leaves), "<u4"))

    def __str__(self) -> str:
        return f"{self.root.hex()}:{base64.b64encode(self.leaves.tobytes()).decode()}"

    def likeness(self, other: "Fingerprint") -> float:
        if self.root == other.root:
            return 1.0
        # Sorted together, a hash that both have m and n times makes a run of m + n; min(m, n) of them are shared.
        a, n = np.unique(self.leaves, return_counts=True)
        b, m = np.unique(other.leaves, return_counts=True)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return float(np.minimum(n[i], m[j]).sum() / max(len(self.leaves), len(other.leaves)))


def edits(old: str, new: str) -> list[tuple[int, int, int, int]]:
    """Spans (start and end in ``old``, start and end in ``new``, code points) that cover all that differs: nothing for equal texts.

    Walks both trees from the root; at each level equal children at the front and the back are left out.
    """
    a, b = tree(old), tree(new)
    if a[0] == b[0]:
        return []

    def sizes(node, level):
        return node[1] if level == 0 else sum(sizes(c, level - 1) for c in node[1]) + (len(node[1]) - 1)

    def walk(x, y, level, i, j):
        front = 0
        while front < min(len(x), len(y)) and x[front][0] == y[front][0]:
            front += 1
        back = 0
        while back < min(len(x), len(y)) - front and x[-1 - back][0] == y[-1 - back][0]:
            back += 1
        for c in x[:front]:
            n = sizes(c, level) + 1
            i, j = i + n, j + n
        x, y = x[front : len(x) - back], y[front : len(y) - back]
        if level and len(x) == 1 and len(y) == 1:
            yield from walk(x[0][1], y[0][1], level - 1, i, j)
        else:
            span = lambda own: sum(sizes(c, level) + 1 for c in own) - 1
            if x and y:
                yield i, i + span(x), j, j + span(y)
            else:  # what came or went brought a separator with it: the one before it, or at the front the one after
                i, j = i - bool(front), j - bool(front)
                yield i, i + (span(x) + 1 if x else 0), j, j + (span(y) + 1 if y else 0)

    return list(walk(a[1], b[1], 2, 0, 0))


def nodes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The trees as rows: doc_id, level (3 root, 2 section, 1 paragraph, 0 phrase), ordinal in its level, digest in hex."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("doc_id", pa.int64()), ("level", pa.int32()), ("ordinal", pa.int32()), ("digest", pa.string())])
        for b in slices(batches, 100):
            rows = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root, sections = tree(t)
                own = [[root], [s[0] for s in sections], [p[0] for s in sections for p in s[1]], [q[0] for s in sections for p in s[1] for q in p[1]]]
                rows += [{"doc_id": doc_id, "level": 3 - k, "ordinal": o, "digest": d.hex()} for k, level in enumerate(own) for o, d in enumerate(level)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "doc_id long, level int, ordinal int, digest string")


def located_edits(pairs: DataFrame, old: str, new: str, id_col: str = "doc_id") -> DataFrame:
    """The spans that differ between columns ``old`` and ``new``: a row a span."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("old_start", "old_end", "new_start", "new_end")]])
        for b in slices(batches, 100):
            rows = [dict(zip(schema.names, (i, *span))) for i, x, y in zip(*(c.to_pylist() for c in b.columns)) for span in edits(x, y)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = pairs.select(F.col(id_col).cast("long"), F.coalesce(F.col(old), F.lit("")), F.coalesce(F.col(new), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, old_start long, old_end long, new_start long, new_end long")


def spliced(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints_beside_edits(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its splice with the next document's (descending ids; after the last: the first), and likenesses."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    laid = by_range(rows, "doc_id", partitions(docs.sparkSession), "text", context=True).select("_context", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        # In ascending order the next document is the row before.
        following, mark = None, None
        for b in slices(batches, 100):
            out = []
            for context, doc_id, t in zip(*(c.to_pylist() for c in b.columns)):
                own = Fingerprint.of(t)
                if following is None:  # no row has an id: the first one stands beside itself
                    following, mark = t, own
                if not context:
                    edited = spliced(t, following)
                    other = Fingerprint.of(edited)
                    out.append((doc_id, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(other), own.likeness(other), own.likeness(mark)))
                following, mark = t, own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], list(names))

    return laid.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_beside_edits(table(spark, sf_dir, "documents"))
