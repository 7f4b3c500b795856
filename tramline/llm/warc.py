"""WARC archives from page rows, and the normaliser for archives that are one gzip stream.

``write_archives`` writes each partition's pages as one whole-file gzip stream, as some crawlers leave them.
``normalise`` inflates such a stream once, writes every record anew as a gzip member of its own, and beside the archive a
sidecar index (JSON lines: archive, offset, length, record id, type, target URI), so one record can be read without the
rest. Both work in pieces of a megabyte and hold one record at a time. Files get names of their own in each attempt;
only those in the manifests count, so a task may run twice.

Defined cases: null html is an empty payload; null url is an empty target; line breaks in a url are left out,
so that no header can be forged; a null page id is written as ``null`` and read back as null;
repeated rows each give a record; an empty table gives no archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialise, partitions, scratch, slices, table, text_bytes

CHUNK = 1 << 20
SALTS = 64
#: Smallest payload that a revisit record may stand for.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    name = record.rsplit(":", 1)[-1].rstrip(">") if record else "null"
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest_hex: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) has the HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def inflated(read) -> Iterator[bytes]:
    """Chunks of what the gzip members that ``read(n)`` gives hold."""
    z = zlib.decompressobj(31)
    while data := read(CHUNK):
        while data:
            yield z.decompress(data, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, one at a time."""
    held, size = bytearray(), None
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if size is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = bytes(held[at:end]).lower().split(b"\r\n")
                size = end - at + 8 + next(int(f[15:]) for f in fields if f.startswith(b"content-length:"))
            if len(held) - at < size:
                break
            yield bytes(held[at : at + size])
            at, size = at + size, None
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with their payload deflated, so that less is moved."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, 200):
            yield b.set_column(2, "payload", pa.array([zlib.compress(p, 1) for p in b.column(2).to_pylist()], pa.binary()))

    return rows.mapInArrow(run, rows.schema)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (deflated), payload_bytes, digest, refers_to. The page that a group of equal payloads keeps has the largest id.

    Groups are found on ids and digests alone, in two steps by salt; the html is moved once, deflated, by page id.
    """
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    light = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    parts = light.groupBy("digest", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.max("top").alias("refers_to"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    groups = groups.filter("n > 1 and refers_to is not null").select("digest", "refers_to", F.explode("salts").alias("salt"))
    again = light.join(groups, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    packed = _packed(rows)
    found = packed.join(again, packed["page_id"].eqNullSafe(again["_page"]) & (packed["digest"] == again["_digest"]), "left")
    # A revisit's payload is not written, so it is not moved on either.
    return found.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Write rows as from ``with_revisits`` as archives, one gzip stream a partition; return the manifest (archive, records)."""

    def write(batches):
        out, n, name = None, 0, f"{path}/{uuid.uuid4().hex}.warc.gz"
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        for b in slices(batches, 200):
            if out is None and b.num_rows:
                fs, inner = file_system(name)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(inner, compression=None)
            for r in zip(*(c.to_pylist() for c in b.columns)):
                out.write(z.compress(record(r[0], r[1], zlib.decompress(r[2]) if r[2] else b"", r[3], r[4], r[5])))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return materialise(pages.mapInArrow(write, "archive string, records long"), "warc-manifest")


def normalise(manifest: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of ``manifest`` below ``path``, a gzip member a record; return (archive, sidecar, records)."""
    spark = manifest.sparkSession

    def write(batches):
        for b in batches:
            for source in b.column("archive").to_pylist():
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                (read_from, inside), (fs, inner) = file_system(source), file_system(name)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                at = n = 0
                with read_from.open_input_stream(inside, compression=None) as raw, fs.open_output_stream(inner, compression=None) as out, fs.open_output_stream(inner + ".idx", compression=None) as idx:
                    for r in records(inflated(raw.read)):
                        fields, _ = parse(r)
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(r) + z.flush()
                        out.write(member)
                        line = {"archive": name, "offset": at, "length": len(member), "record_id": fields["warc-record-id"], "type": fields["warc-type"], "target": fields["warc-target-uri"]}
                        idx.write(json.dumps(line).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "sidecar": [name + ".idx"], "records": [n]}, pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("records", pa.int64())]))

    return materialise(manifest.select("archive").repartition(partitions(spark), "archive").mapInArrow(write, "archive string, sidecar string, records long"), "warc-normalised")


def read_index(normalised: DataFrame) -> DataFrame:
    """archive, offset, length of all records in the sidecars of ``normalised``."""

    def read(batches):
        for b in batches:
            for sidecar in b.column("sidecar").to_pylist():
                fs, inner = file_system(sidecar)
                held = {"archive": [], "offset": [], "length": []}
                with fs.open_input_stream(inner, compression=None) as raw:
                    for line in _lines(raw.read):
                        entry = json.loads(line)
                        for k, v in held.items():
                            v.append(entry[k])
                        if len(held["archive"]) == 10_000:
                            yield pa.RecordBatch.from_pydict(held)
                            held = {k: [] for k in held}
                yield pa.RecordBatch.from_pydict(held, pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return normalised.select("sidecar").mapInArrow(read, "archive string, offset long, length long")


def _lines(read) -> Iterator[bytes]:
    held = b""
    while data := read(CHUNK):
        *whole, held = (held + data).split(b"\n")
        yield from whole


def read_records(index: DataFrame) -> DataFrame:
    """One row a record, each inflated alone at its offset: page_id, url, type, payload_bytes, digest (hex), refers_to, payload (null for revisits).

    A response whose payload differs from its digest is an error.
    """

    def read(batches):
        names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        for b in slices(batches, 200):
            rows, opened = [], (None, None)
            for archive, offset, length in zip(*(b.column(k).to_pylist() for k in ("archive", "offset", "length"))):
                if opened[0] != archive:
                    if opened[1]:
                        opened[1].close()
                    fs, inner = file_system(archive)
                    opened = (archive, fs.open_input_file(inner))
                fields, block = parse(zlib.decompress(opened[1].read_at(length, offset), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(h[15:]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                response = fields["warc-type"] == "response"
                if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
                rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], size, digest, page_of(fields.get("warc-refers-to")), payload if response else None))
            if opened[1]:
                opened[1].close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], list(names))

    return index.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    raw = write_archives(with_revisits(table(spark, sf_dir, "pages")), path + "/raw")
    index = read_index(normalise(raw, path + "/records"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM q
"""
