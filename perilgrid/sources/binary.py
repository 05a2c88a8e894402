"""Binary map formats, read through Spark's own file access: map extracts in protocol buffers and shape
files. A file is cut into its blocks or records first; those are dealt out and decoded in parallel."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- protocol buffers --------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned number of 7-bit groups, low ones first, and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; values of fixed width are given as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value
        else:
            n = 8 if kind == 1 else 4
            if kind == 2:
                n, at = varint(data, at)
            yield key >> 3, data[at : at + n]
            at += n


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def running(data: bytes) -> list[int]:
    """Signed differences added up."""
    out, total = [], 0
    for n in packed(data):
        total += zigzag(n)
        out.append(total)
    return out


def blocks(data: bytes) -> Iterator[bytes]:
    """The unpacked data blocks of a map extract."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        head = dict(fields(data[at + 4 : at + 4 + n]))
        at += 4 + n
        size = head[3]
        blob = dict(fields(data[at : at + size]))
        at += size
        if head[1] == b"OSMData":
            if 1 not in blob and 3 not in blob:
                raise ValueError("a block is packed in a way other than zlib")
            yield blob[1] if 1 in blob else zlib.decompress(blob[3])


def elements(block: bytes) -> Iterator[tuple[str, int, float | None, float | None, list[int] | None, dict[str, str]]]:
    """(kind, id, lon, lat, refs, tags) of the nodes and ways in a block."""
    parts: dict[int, list] = {}
    for k, v in fields(block):
        parts.setdefault(k, []).append(v)
    strings = [v.decode("utf-8", "replace") for k, v in fields(parts[1][0]) if k == 1]
    grain = parts.get(17, [100])[0]
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    lat0, lon0 = signed(parts.get(19, [0])[0]), signed(parts.get(20, [0])[0])
    place = lambda n, zero: 1e-9 * (zero + grain * n)

    def tags(message: dict[int, bytes]) -> dict[str, str]:
        return {strings[a]: strings[b] for a, b in zip(packed(message.get(2, b"")), packed(message.get(3, b"")))}

    for group in parts.get(2, []):
        for k, v in fields(group):
            m = dict(fields(v)) if k in (1, 2, 3) else {}
            if k == 1:
                yield "node", zigzag(m[1]), place(zigzag(m[9]), lon0), place(zigzag(m[8]), lat0), None, tags(m)
            elif k == 2:
                pairs = packed(m.get(10, b""))
                own: list[dict[str, str]] = [{}]
                i = 0
                while i < len(pairs):
                    if pairs[i] == 0:
                        own.append({})
                        i += 1
                    else:
                        own[-1][strings[pairs[i]]] = strings[pairs[i + 1]]
                        i += 2
                for j, (ref, lat, lon) in enumerate(zip(running(m[1]), running(m[8]), running(m[9]))):
                    yield "node", ref, place(lon, lon0), place(lat, lat0), None, own[j] if j < len(own) else {}
            elif k == 3:
                yield "way", m[1], None, None, running(m.get(8, b"")), tags(m)


def extract(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, lon, lat, refs, tags) of a map extract's nodes and ways."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                for i, block in enumerate(blocks(data)):
                    yield pd.DataFrame({"i": [i], "block": [block]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b["block"]:
                yield pd.DataFrame(list(elements(block)), columns=["kind", "id", "lon", "lat", "refs", "tags"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "i long, block binary")
    return raw.repartition(4 * spark.sparkContext.defaultParallelism, "i").mapInPandas(decode, "kind string, id long, lon double, lat double, refs array<long>, tags map<string, string>")


def roads(spark: SparkSession, path: str, classes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a map extract: nodes (ref, lon, lat), ways (way, refs, highway, maxspeed, bridge) of the given
    road classes, and marks (id, lon, lat, kind): level crossings and points that slow traffic down."""
    e = extract(spark, path)
    tag = lambda k: F.try_element_at(F.col("tags"), F.lit(k))
    nodes = e.where("kind = 'node'")
    ways = e.where("kind = 'way'").where(tag("highway").isin(*classes))
    bridge = F.coalesce(tag("bridge") != "no", F.lit(False))
    slow = F.when(tag("railway") == "level_crossing", "rail").when(tag("highway").isin("traffic_signals", "crossing", "stop", "give_way", "mini_roundabout"), "junction")
    marks = nodes.withColumn("kind", slow).where("kind is not null").select("id", "lon", "lat", "kind")
    return nodes.select(F.col("id").alias("ref"), "lon", "lat"), ways.select(F.col("id").alias("way"), "refs", tag("highway").alias("highway"), tag("maxspeed").alias("maxspeed"), bridge.alias("bridge")), marks


# --- shape files -------------------------------------------------------------------------------


def shape_records(data: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(number, parts) of each record of points, lines or polygons; null shapes have no parts."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack_from("<i", body)
        parts: list[list[tuple[float, float]]] = []
        if kind in (1, 11, 21):
            parts = [[struct.unpack_from("<2d", body, 4)]]
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
            xy = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * n_parts)
            points = list(zip(xy[::2], xy[1::2]))
            parts = [points[a:b] for a, b in zip(starts, starts[1:])]
        elif kind != 0:
            raise ValueError(f"shapes of kind {kind} aren't read")
        yield number - 1, parts


def attribute_records(data: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, dict[str, str]]]:
    """(number, values) of each record of an attribute table; deleted records keep their numbers."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    names, at = [], 32
    while data[at] != 13:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        names.append((name, data[at + 16]))
        at += 32
    for i in range(n):
        row, at, out = data[head + i * width : head + (i + 1) * width], 1, {}
        for name, size in names:
            out[name] = row[at : at + size].decode(encoding, "replace").strip(" \0")
            at += size
        yield i, out


def shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(i, parts, attributes) of a shape file and the attribute table beside it: parts is an array of
    arrays of structs x, y, in the file's own coordinates."""

    def geometry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                rows = [(i, [[{"x": x, "y": y} for x, y in p] for p in parts]) for i, parts in shape_records(data)]
                for lo in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[lo : lo + 1000], columns=["i", "parts"])

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                yield pd.DataFrame(list(attribute_records(data, encoding)), columns=["i", "attributes"])

    read = lambda p: spark.read.format("binaryFile").load(p).select("content")
    g = read(path).mapInPandas(geometry, "i long, parts array<array<struct<x: double, y: double>>>")
    a = read(path[:-4] + ".dbf").mapInPandas(values, "i long, attributes map<string, string>")
    return g.join(a, "i", "left")
