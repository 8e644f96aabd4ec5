"""Content-addressed archive of web records.

A record is a header, exactly as it stands, a payload, and what follows it. The payload's bytes are stored once, under
their SHA-256; the header, the trailer and the digest are stored for each record. Records come back byte for byte by a
join on the digest. Digests are verified twice: when payloads of one digest meet, their bytes are compared, and when a
payload is read, its digest is computed again.

Payloads travel and rest compressed. They are shuffled once to meet their equals and once for the join; headers are
small. Payloads of one digest meet in one task, one after the other, so that task needs no memory for their number, and
equal payloads of one batch are sent once. In the join, AQE splits a digest that very many records share.

Defined cases: a null payload counts as empty; a null id or url is kept, as an empty header field; repeated records are
each restored; other columns are ignored; an empty table gives an empty archive. A digest whose payloads differ, or a
payload that no longer fits its digest, is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

DATE = "1970-01-01T00:00:00Z"
RECORDS = "record_id long, header binary, payload binary, trailer binary"


def records_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(record_id, header, payload, trailer) of web pages, as WARC 1.0 response records."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    lines = [
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.col("url").cast("string"), F.lit(""))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(html, 256)),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("record_id"), header.cast("binary").alias("header"), html.cast("binary").alias("payload"), F.lit("\r\n\r\n").cast("binary").alias("trailer"))


def split_record(raw: bytes) -> tuple[bytes, bytes, bytes]:
    """(header with its blank line, payload, trailer) of a raw WARC record; a record without Content-Length is all header."""
    end = raw.find(b"\r\n\r\n")
    head = raw if end < 0 else raw[: end + 4]
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            n = int(value)
            return head, raw[len(head) : len(head) + n], raw[len(head) + n :]
    return raw, b"", b""


def records_of_raw(raw: DataFrame) -> DataFrame:
    """(record_id, header, payload, trailer) of (record_id, raw)."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split_record(x or b"") for x in b.column("raw").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("record_id"), *(pa.array([p[i] for p in parts], pa.binary()) for i in range(3))], ["record_id", "header", "payload", "trailer"])

    return common.each_batch(raw.select(F.col("record_id").cast("long").alias("record_id"), F.col("raw").cast("binary").alias("raw")), batch, RECORDS)


def split_file(data: bytes) -> Iterator[bytes]:
    """The records of a WARC file, whole; members compressed with gzip are unpacked. Joined they are the unpacked file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        stop = len(data)
        if end >= 0:
            length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", data[at : end + 2])
            stop = min(end + 4 + int(length[1]) if length else end + 4, len(data))
            while data[stop : stop + 1] in (b"\r", b"\n") and stop < len(data):
                stop += 1
        yield data[at:stop]
        at = stop


def records_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, header, payload, trailer) of all records of WARC files; ids are hashes of (file, place). A task holds a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(f"{p}:{i}", raw) for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for i, raw in enumerate(split_file(data or b""))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "raw"])

    raw = common.each_batch(files, batch, "name string, raw binary")
    return records_of_raw(raw.select(F.xxhash64("name").alias("record_id"), "raw"))


def _packed(records: DataFrame) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        seen: dict[bytes, bytes] = {}
        for p in b.column("payload").to_pylist():
            p = p or b""
            if seen.setdefault(hashlib.sha256(p).digest(), p) != p:
                raise ValueError("two payloads have one digest")
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([pack(p) for p in seen.values()], pa.binary())], ["digest", "packed"])

    return common.each_batch(records.select("payload"), batch, "digest binary, packed binary")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of digest, the first of each; the others must have its bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    last, bytes_ = None, b""
    for b in batches:
        digests, packed = b.column("digest").to_pylist(), b.column("packed")
        keep = []
        for i, d in enumerate(digests):
            p = packed[i].as_py()
            if d != last:
                keep.append(i)
                last, bytes_ = d, p
            elif p != bytes_ and unpack(p) != unpack(bytes_):  # workers of other versions may pack the same bytes otherwise
                raise ValueError(f"payloads of digest {d.hex()} differ")
        if keep:
            yield b.take(pa.array(keep))


def write(records: DataFrame, path: str) -> None:
    """Writes path/payloads, each payload once, and path/headers."""
    packed = _packed(records).repartition("digest").sortWithinPartitions("digest")
    common.map_arrow(packed, _once, "digest binary, packed binary").write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    digest = F.unhex(F.sha2(F.coalesce("payload", F.lit("").cast("binary")), 256)).alias("digest")
    records.select("record_id", "header", "trailer", digest).write.parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, digest, record) of every record of the archive, byte for byte."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        out, last, payload = [], None, b""
        for h, t, d, p in zip(*(b.column(c).to_pylist() for c in ("header", "trailer", "digest", "packed")), strict=True):
            if d != last:
                if p is None:
                    raise ValueError(f"no payload of digest {d.hex()}")
                last, payload = d, unpack(p)
                if hashlib.sha256(payload).digest() != d:
                    raise ValueError(f"the payload of digest {d.hex()} has changed")
            out.append((h or b"") + payload + (t or b""))
        return pa.RecordBatch.from_arrays([b.column("record_id"), b.column("digest"), pa.array(out, pa.binary())], ["record_id", "digest", "record"])

    return common.each_batch(headers.join(payloads, "digest", "left").select("record_id", "digest", "header", "trailer", "packed"), batch, "record_id long, digest binary, record binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and restored."""
    path = common.new_path(spark, "archive")
    write(records_of_pages(common.table(spark, sf_dir, "pages")), path)
    back = read(spark, path)
    return back.select(F.col("record_id").alias("page_id"), F.lower(F.hex("digest")).alias("digest"), F.decode("record", "UTF-8").alias("record"))


ORACLE = f"""
SELECT page_id, sha256(coalesce(html, '')) AS digest,
  'WARC/1.0' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || crlf
  || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'WARC-Date: {DATE}' || crlf || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || crlf
  || 'Content-Type: text/html' || crlf || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || crlf || crlf || coalesce(html, '') || crlf || crlf AS record
FROM pages, (SELECT chr(13) || chr(10) AS crlf)
"""
