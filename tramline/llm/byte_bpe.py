"""Byte-level BPE by a rank file, through the tokenizers library over Arrow batches.

The rank file's byte strings become a vocabulary over the byte-to-character table of byte-level BPE. Where a token can
be put together in several ways, every way is a merge with the token's rank, as merging by ranks allows them all; a
whole match that is a token is taken as it stands. Decoding looks token bytes up in one table and gathers those of a
whole batch at once; bytes stay bytes until the end, so a character that two tokens share comes out whole.

Defined cases: null is empty and has no ids; bytes that are no UTF-8 after cutting a token stream decode with the replacement
character in ``decoded_text`` and stay as they are in ``decoded``; an empty table gives no rows; further columns pass
through ``encode`` and ``decode`` unless they have the name of a new one, which then replaces them.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions, slices, table, unused
from .pieces import encoder as piece_encoder


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranked_tokenizer(path: str, pattern: str):
    """A tokenizers Tokenizer that merges as the rank file at ``path`` says."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    as_text = {token: "".join(map(shown.__getitem__, token)) for token in ranks}
    merges = [
        (as_text[token[:at]], as_text[token[at:]])
        for token in sorted(ranks, key=ranks.get)
        for at in range(1, len(token))
        if token[:at] in ranks and token[at:] in ranks
    ]
    t = Tokenizer(models.BPE({as_text[token]: rank for token, rank in ranks.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    return t


class ByteTable:
    """Token bytes by id, flat, for whole batches at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        starts_char = (self.flat & 0xC0) != 0x80
        self.characters = np.add.reduceat(starts_char, self.start).astype(np.int64) if len(tokens) else np.zeros(0, np.int64)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the byte at which each id begins (one more at the end)."""
        n = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(self.start[ids] - ends[:-1], n)
        take += np.arange(ends[-1])
        return self.flat[take], ends


@functools.cache
def _table(path: str) -> ByteTable:
    return ByteTable(read_ranks(path))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as ids and (``offsets``) starts."""
    encoder = piece_encoder(lambda: ranked_tokenizer(path, pattern), "spaces", path, pattern)
    for b in portions(batches, -1):
        ids, ends = encoder.encode(b.column(b.num_columns - 1))
        ids, ends = ids.astype(np.int32), ends.astype(np.int32)
        new, names = [pa.ListArray.from_arrays(ends, pa.array(ids))], ["ids"]
        if offsets:
            chars = _table(path).characters[ids]
            after = np.cumsum(chars)
            base = np.repeat(np.concatenate([[0], after])[ends[:-1]], np.diff(ends))
            first = _table(path).flat[_table(path).start[ids]]
            # A token that begins inside a character begins in the one before.
            at = after - chars - base - ((first & 0xC0) == 0x80)
            new.append(pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))))
            names.append("starts")
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], *names])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the ids in column ``at``, as one more column."""
    for b in slices(batches):
        lists = b.column(at).fill_null([]) if b.column(at).null_count else b.column(at)
        n = np.asarray(lists.value_lengths())
        data, ends = _table(path).gather(lists.flatten().to_numpy())
        cut = ends[np.concatenate([[0], np.cumsum(n)])]
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([raw[i:j] for i, j in zip(cut[:-1], cut[1:])], pa.binary())], [*b.schema.names, "decoded"])


IDS, STARTS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Add ``ids`` array<int> and, with ``offsets``, ``starts`` array<int>: the code point in which each token's first byte lies. Columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "starts")]
    schema = T.StructType([*kept, IDS, *[STARTS] * offsets])
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text), F.lit("")).alias(unused("_text", *docs.columns)))
    return rows.mapInArrow(lambda batches: _encoded(batches, path, pattern, offsets), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` binary: the bytes of the tokens in ``ids`` (null: none). A column of that name is replaced."""
    kept = [f for f in coded.schema.fields if f.name != "decoded"]
    at = [f.name for f in kept].index(ids)
    return coded.select(*[f.name for f in kept]).mapInArrow(lambda batches: _decoded(batches, path, at), T.StructType([*kept, DECODED]))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass through Python: doc_id, ids, decoded."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema.fields[0], IDS, DECODED])
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern, False), path, 1), schema)


def decoded_text(decoded: str = "decoded"):
    """The decoded bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(F.col(decoded).cast("string"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
