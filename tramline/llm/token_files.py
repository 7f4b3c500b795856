"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a row of blocks of at most ``BLOCK`` ids. A block holds a header (magic, documents, ids, distinct ids, data
bytes), the documents' ids and lengths, the distinct token ids from most to least frequent in the block (ties: smaller
id), control bytes (four ids each, two bits an id: data bytes less one) and the data bytes of the ranks, little-endian.
The commonest 256 ids so take one byte. Decoding looks each control byte up in a table of data lengths and places the
bytes of all ids at once. A document longer than a block goes on in the next one. Blocks are self-contained, so a task
holds one block at a time.

Defined cases: null text is empty and gives the end id alone; null ids are kept (flag beside the id) and sort first; repeated rows are kept,
ordered by text; an empty table gives no documents; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, by_range, file_system, materialise, partitions, portions, scratch, table
from .pieces import encoder as piece_encoder

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sIIII")
BLOCK = 1 << 20
#: Data bytes of the four ids that each control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One block: ``counts`` ids of ``ids`` for each of ``doc_ids``."""
    ids = ids.astype(np.uint32)
    seen = np.bincount(ids)
    ranked = np.lexsort((np.arange(len(seen)), -seen))[: np.count_nonzero(seen)].astype("<u4")
    rank_of = np.zeros(len(seen), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids].astype("<u4")
    width = np.ones(len(ranks), np.uint8)
    for more in (1 << 8, 1 << 16, 1 << 24):
        width += ranks >= more
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < width[:, None]]
    own = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes() + np.array(counts, "<u4").tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(ranked), len(data)) + own + ranked.tobytes() + control.astype(np.uint8).tobytes() + data.tobytes()


def decode_blocks(read) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, null flags, counts, token ids) of each block that ``read(n)`` gives."""
    while head := read(HEAD.size):
        magic, docs, n, distinct, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        doc_ids, none = np.frombuffer(read(8 * docs), "<i8"), np.frombuffer(read(docs), np.uint8).astype(bool)
        counts, ranked = np.frombuffer(read(4 * docs), "<u4"), np.frombuffer(read(4 * distinct), "<u4")
        width = LENGTHS[np.frombuffer(read(-(-n // 4)), np.uint8)].reshape(-1)[:n]
        ranks = np.zeros((n, 4), np.uint8)
        ranks[np.arange(4) < width[:, None]] = np.frombuffer(read(size), np.uint8)
        yield doc_ids, none, counts, ranked[ranks.reshape(-1).view("<u4")] if n else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, text: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Encode ``docs`` in ascending id order into one file a partition below ``path``; return the manifest
    (part, file, n_docs, n_ids), written as a table there. A retried task writes a file of its own name; the manifest lists those that count."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    laid = by_range(rows, "doc_id", partitions(spark), "text").select("_part", "doc_id", "text")

    def write(batches):
        encoder = piece_encoder(lambda: Tokenizer.from_file(tokenizer_path), "words", tokenizer_path)
        part, n_docs, n_ids, out, name = None, 0, 0, None, ""
        ids, counts, held, size = [], [], [], 0

        def flush():
            nonlocal ids, counts, held, size
            if ids:
                out.write(encode_block(ids, counts, np.concatenate(held)))
            ids, counts, held, size = [], [], [], 0

        for b in portions(batches, 2):
            if out is None:
                part = b.column(0)[0].as_py()
                name = f"{path}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tids"
                fs, inner = file_system(path)
                fs.create_dir(inner, recursive=True)
                out = fs.open_output_stream(f"{inner}/{name.rsplit('/', 1)[-1]}", compression=None)
            coded, ends = encoder.encode(b.column(2))
            coded, ends = np.insert(coded, ends[1:], end_id), ends + np.arange(len(ends))
            n_docs, n_ids = n_docs + b.num_rows, n_ids + len(coded)
            for doc_id, first, last in zip(b.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                for at in range(first, last, block):
                    piece = coded[at : min(at + block, last)]
                    n = len(piece)
                    if size + n > block:
                        flush()
                    # A continued document has its id again, with a count of its own, marked by a block that begins with it.
                    ids.append(doc_id)
                    counts.append(n if at == first else n | 1 << 31)
                    held.append(piece)
                    size += n
        if out is not None:
            flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialise(laid.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(part, doc_id, at, n_tokens, ids binary: little-endian unsigned 32-bit) of each document; ``at``: ids of the file before it."""
    spark = manifest.sparkSession

    def read(batches):
        for b in batches:
            for part, name in zip(b.column("part").to_pylist(), b.column("file").to_pylist()):
                fs, inner = file_system(name)
                with fs.open_input_stream(inner, compression=None) as f:
                    yield from _documents(part, f.read)

    return manifest.repartition(partitions(spark), "file").mapInArrow(read, "part int, doc_id long, at long, n_tokens long, ids binary")


def _documents(part: int, read) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    at, held, rows = 0, [], []
    open_id = None

    def close():
        nonlocal held, at
        if held:
            ids = b"".join(held)
            rows.append((part, open_id, at, len(ids) // 4, ids))
            at += len(ids) // 4
            held = []

    for doc_ids, none, counts, ids in decode_blocks(read):
        cut = np.concatenate([[0], np.cumsum(counts & 0x7FFFFFFF, dtype=np.int64)])
        for k in range(len(counts)):
            if not counts[k] >> 31:
                close()
                open_id = None if none[k] else int(doc_ids[k])
            held.append(ids[cut[k] : cut[k + 1]].tobytes())
            if len(rows) >= SLICE:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                rows = []
    close()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def with_starts(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before. The running sum goes over one row a file."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", before.alias("base"))
    return docs.join(F.broadcast(files), "part").withColumn("start", F.col("base") + F.col("at"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, scratch(spark, "token-files"))
    docs = with_starts(read_token_files(manifest), manifest)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
