"""WARC archives, index first.

Records are written as gzip members into archive files in the shared folder; each writer returns an
index row per record (file, offset, length, URL, digest). The index is a table of its own, so only
the records of tasks that committed are listed; what a lost task left behind is never read. A read
selects index rows, sorts them by place, and coalesces neighbouring byte ranges into one request.
"""

from __future__ import annotations

import base64
import hashlib

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, scratch_path, utf8

GAP = 64 << 10
SPAN = 8 << 20
FILE_BYTES = 1 << 30
BLOCK = 16 << 20
_CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: bytes | None, payload: bytes, payload_digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record, uncompressed. A revisit holds no payload; its header says how long that is."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    target = b"".join(b"%%%02X" % c if c < 33 or c == 37 else bytes([c]) for c in url or b"")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    head += [b"WARC-Target-URI: " + target] * (url is not None)
    head += [b"WARC-Payload-Digest: sha1:" + payload_digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%s>" % str(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return _CRLF.join(head) + _CRLF * 2 + block + _CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, block = raw.partition(_CRLF * 2)
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    return headers, block.partition(_CRLF * 2)[2]


#: Names that Spark's file systems have of their own, and those that Arrow knows the same stores by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or local path), and the path there. Archives are plain files, so the
    shared folder has to be in a store that Arrow reaches; any other is an error that names it."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file":
        return fs.FileSystem.from_uri("file://" + "/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def _pack(raw: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def plan(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with key (hex SHA-1 of the payload) and first (the page_id of the
    response among the records with this payload)."""
    keyed = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = keyed.withColumn("key", F.sha1(F.col("html").cast("binary")))
    largest = keyed.groupBy("key").agg(F.max("page_id").alias("first"))
    return keyed.join(largest.hint("shuffle_hash"), "key")


def write(pages: DataFrame, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the index (file,
    offset, length, page_id, url, digest). Of records with equal payloads of at least least_bytes
    the one with the largest page_id is the response, the others revisit it."""
    folder = scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _place(folder)
        disk.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for b in batches:
            rows = []
            firsts = b.column("first").to_pylist()
            for page, url, html, first in zip(b.column("page_id").to_pylist(), utf8(b.column("url")), utf8(b.column("html")), firsts):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    file = f"{uuid.uuid4().hex}.warc.gz"  # a repeated task writes a file of its own
                    name, out, at = f"{folder}/{file}", disk.open_output_stream(f"{root}/{file}", compression=None), 0
                d = digest(html)
                raw = _pack(record(page, url, html, d, first, len(html) >= least_bytes and first is not None and page != first))
                out.write(raw)
                rows.append((name, at, len(raw), page, url, d))
                at += len(raw)
            cols = list(zip(*rows))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), b.column("page_id"), pa.array(cols[4], pa.binary()).cast(pa.string()), pa.array(cols[5])],
                    ["file", "offset", "length", "page_id", "url", "digest"],
                )
        if out:
            out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    index = plan(pages).mapInArrow(run, f"file string, offset bigint, length bigint, page_id {kind}, url string, digest string")
    return save(index, "warc-index")[0]


def coalesce(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """(start, end, members) of byte ranges that cover sorted (offset, length) rows: neighbours
    within gap share a range, up to span bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, n) in enumerate(rows):
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= span:
            start, end, members = out[-1]
            members.append(i)
            out[-1] = (start, max(end, at + n), members)
        else:
            out.append((at, at + n, [i]))
    return out


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that index rows name: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (text of the response's id)[, payload (null for revisits)]. The digest of a response
    is computed from the payload as read, and one that differs from its header is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened = None, None
        for b in batches:
            files = b.column("file").to_pylist()
            places = list(zip(b.column("offset").to_pylist(), b.column("length").to_pylist()))
            i, n = 0, b.num_rows
            while i < n:
                j = i
                while j < n and files[j] == files[i]:
                    j += 1
                if opened != files[i]:
                    if handle:
                        handle.close()
                    disk, path = _place(files[i])
                    handle, opened = disk.open_input_file(path), files[i]
                for start, end, members in coalesce(places[i:j]):
                    handle.seek(start)
                    data = handle.read(end - start)
                    rows = []
                    for k in members:
                        at, size = places[i + k]
                        headers, payload = parse(zlib.decompress(data[at - start : at - start + size], 31))
                        revisit = headers["WARC-Type"] == "revisit"
                        d = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != d:
                            raise ValueError(f"record at {files[i]}:{at} doesn't match its digest")
                        refers = headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else None
                        rows.append((int(headers["X-Payload-Length"]) if revisit else len(payload), d, headers["WARC-Type"], refers, None if revisit else payload))
                    cols = list(zip(*rows))
                    own = pa.array([i + k for k in members])
                    arrays = [b.column("page_id").take(own), b.column("url").take(own), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.string())]
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    if with_payload:
                        arrays.append(pa.array(cols[4], pa.binary()))
                        names.append("payload")
                    yield pa.RecordBatch.from_arrays(arrays, names)
                i = j
        if handle:
            handle.close()

    kind = index.schema["page_id"].dataType.simpleString()
    placed = index.select("file", "offset", "length", "page_id", "url", (F.col("offset") / BLOCK).cast("long").alias("block"))
    placed = placed.repartition("file", "block").sortWithinPartitions("file", "offset").drop("block")
    schema = f"page_id {kind}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    return placed.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a record is written for
    each row of pages(page_id, url, html) and all archives are read back.

    Payload: html in UTF-8; null html: empty. Payloads are equal if they have the same SHA-1.
    Repeated rows of the largest page_id of a payload are all responses. A null page_id is never the
    largest; it revisits the response, or is a response where all ids are null. Other columns aren't
    read; an empty table gives an empty result."""
    kind = pages.schema["page_id"].dataType.simpleString()
    index = write(pages.select("page_id", "url", "html"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
