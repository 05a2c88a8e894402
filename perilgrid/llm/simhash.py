"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to 32 counts, the set bits of each 2-bit segment. The Manhattan
distance of two count vectors is at most the Hamming distance of the fingerprints, so it is a lower
bound to filter by. A range join on the unit grid finds all pairs within that bound: of two vectors
at distance <= 3, one half (16 counts) differs by at most 1, so both fingerprints meet in a cell if
each is dealt to the cell of each half and to the cells one step up from it. Hamming distances are
then verified exactly within each cell. A cell emits a spanning forest of its links, never all pairs.

For similar shingle sets, whose fingerprints differ in too many bits for a grid, texts are met by the
fingerprints of their sections as well, and every pair that meets is compared exactly. What this leaves
apart is met by the rarest shingles, of which similar sets have to share one; so no similar pair is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop, release, save, sorted_groups, text_slices, tidied, utf8

RADIUS = 3
_SLICE = 1 << 15


def shingles(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle of a whole text in lower case, in order; of the whole sequence where
    there are fewer words; none where there are no words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, seed)], "<u8")
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - shingle].tolist()
    end = end[shingle - 1 :].tolist()
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(start, end)), "<u8", len(start))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles, as an unsigned 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        ones += _bits(hashes[k : k + _SLICE]).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text, as an unsigned 64-bit number."""
    return majority(shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, fp bigint")


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links (<= radius differing bits) among distinct fingerprints."""
    a, b, left = [], [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                todo.extend(found)
    return a, b


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, "cell"):
        cell, fp = (t.column(c).to_numpy() for c in ("cell", "fp"))
        fp = fp.view(np.uint64)
        start = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
        size = np.diff(np.r_[start, len(cell)])
        two = start[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            x, y = forest(fp[s : s + n], radius)
            a += x
            b += y
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def _cells() -> F.Column:
    """Of a fingerprint fp: the grid cells of both halves' counts, and those one step up."""

    def half(shift: int) -> str:
        x = f"(shiftrightunsigned(fp, {shift}) & 4294967295L)"
        c = f"({x} - (shiftrightunsigned({x}, 1) & 1431655765L))"
        tag = f"{shift // 32} * 4294967296L"
        up = f"transform(sequence(0, 15), j -> if((shiftrightunsigned({c}, 2 * j) & 3L) < 2, {c} + shiftleft(1L, 2 * j) + {tag}, null))"
        return f"concat(array({c} + {tag}), filter({up}, x -> x is not null))"

    return F.expr(f"concat({half(0)}, {half(32)})")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of distinct fingerprints fps(fp), enough of them to connect all that are linked. The
    grid is exact for a radius of up to 3."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the grid finds links of up to {RADIUS} differing bits")
    cells = fps.select("fp", F.explode(_cells()).alias("cell")).select("cell", "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidied(lambda batches: _links(batches, radius)), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    Lower-cases A-Z, takes words and shingles of ``shingle`` words, repeats included (fewer words: the
    whole sequence; none: fingerprint 0, linked like any other). A bit is set if it is set in over half
    the shingles' XXH64. Fingerprints with at most ``radius`` (0 to 3) differing bits are linked;
    component_id is the smallest doc_id reachable. Equal fingerprints are one node, so copies cost
    nothing. Texts are taken whole, however long.

    Null text: as an empty one. Null doc_id: the row gets a component by its fingerprint, and is
    never the smallest (component_id is null if its whole component has null ids). Repeated rows
    stay. Other columns are not read. An empty table gives an empty result."""
    fps, _ = save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes, _ = save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets ----------------------------------------------------------------

#: Shingles in a section on average, the fewest in one that counts, and how many count of a text.
SECTION, LEAST, SECTIONS = 16, 6, 4
#: Texts with which those of one set of sections are compared: the first by so many hashes.
LEADS = 3
#: Differing bits of two texts' fingerprints up to which they are compared. At a similarity of 0.8 the
#: bits that differ number 9.7 on average with a deviation of 2.9.
WIDE = 20
#: One text in so many is read for frequent shingles, and how many of them are known at most. They give the
#: order of the shingles only: any order finds all pairs, one by rarity compares fewer.
SAMPLE, FREQUENT = 16, 100_000
#: Of the pairs that share enough of the rarest shingles, one in so many is compared at first, chosen by the
#: ids. That joins large groups, so that of the others only those between groups are left to compare.
EARLY = 16
#: Pairs that a task looks at together.
_PAIRS = 1 << 19
#: Bytes of text that a task holds as single values.
_TEXT = 1 << 22


def sections(hashes: np.ndarray) -> list[int]:
    """Fingerprints of at most SECTIONS sections of a text. Sections begin at shingles whose hash is
    divisible by SECTION, so an edit moves no border but its own; those with the smallest hashes at
    their beginnings count, so that similar texts choose the same."""
    edge = np.flatnonzero(hashes % np.uint64(SECTION) == 0)
    start = np.unique(np.r_[0, edge])
    size = np.diff(np.r_[start, len(hashes)])
    fine = np.flatnonzero(size >= LEAST)
    if not len(fine):
        return []
    rank = hashes[start[fine]] * np.uint64(0x9E3779B97F4A7C15)
    chosen = fine[np.argsort(rank, kind="stable")[:SECTIONS]]
    return [majority(hashes[a : a + n]) for a, n in zip(start[chosen].tolist(), size[chosen].tolist())]


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and numbers of the shingles that several of a sample of rows(key, text) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, ["text"], _TEXT)):
            for t in utf8(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(t, shingle)).view(np.int64))], ["h"])

    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").distinct()
    n = some.mapInArrow(tidied(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    t = n.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def rarest(hashes: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of distinct hashes, ascending: the first in an order that is the same for all texts, frequent ones
    last, as many as one has to share with any set whose Jaccard similarity is least or more."""
    n = len(hashes)
    many = n - _at_least(least * n) + 1 if n else 0
    known, times = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[at] == hashes, times[at], 0)
        hashes = hashes[np.argsort(often, kind="stable")]
    return hashes[:many]


def _at_least(x):
    """The least whole number that isn't below x, but for rounding."""
    return np.ceil(x - 1e-9).astype(np.int64)


def _sketches(rows: DataFrame, shingle: int, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, same, fp, parts, size, rare) of rows(key, text): a digest of the text's words in lower case, its
    fingerprint, those of its sections, the number of its distinct shingles and the rarest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, ["text"], _TEXT)):
            same, fps, parts, sizes, rare = [], [], [], [], []
            for t in utf8(b.column("text")):
                h = shingles(t, shingle)
                same.append(hashlib.blake2b(b" ".join((t or b"").lower().split()), digest_size=16).digest())
                fps.append(majority(h))
                parts.append(np.unique(np.array(sections(h), np.uint64)).view(np.int64))
                h = np.unique(h)
                sizes.append(len(h))
                rare.append(rarest(h, least, frequent).view(np.int64))
            longs = pa.list_(pa.int64())
            arrays = [b.column("key"), pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(parts, longs), pa.array(sizes, pa.int32()), pa.array(rare, longs)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "same", "fp", "parts", "size", "rare"])

    return rows.select("key", "text").mapInArrow(tidied(run), "key binary, same binary, fp bigint, parts array<bigint>, size int, rare array<bigint>")


def _similar(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(a, b) of those pairs(a, b, x, y) whose texts x and y have shingle sets with a Jaccard similarity of
    least or more, compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole, ["x", "y"], _TEXT)):
            keep = []
            for x, y in zip(utf8(b.column("x")), utf8(b.column("y"))):
                x, y = (np.unique(shingles(t, shingle)) for t in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            own = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(own), b.column("b").take(own)], ["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(tidied(run), "a bigint, b bigint")


def _chosen(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Whether a pair of ids is one of one in share pairs, the same ones wherever it is met."""
    x = np.minimum(a, b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(share) == 0


def _sharing(batches: Iterator[pa.RecordBatch], least: float, share: int = 1) -> Iterator[pa.RecordBatch]:
    """(a, b, n, need) of rows (h, size, id, root), sorted by h, size and id: n of the rarest hashes are
    shared by ids of different roots, need of which sets of a similarity of least or more share. All that
    they share in the longer rest of the two sets isn't enough without them. Of one in share pairs."""
    for t in sorted_groups(batches, "h"):
        h, size, ids, root = (t.column(c).to_numpy() for c in ("h", "size", "id", "root"))
        start = np.r_[0, np.flatnonzero(np.diff(h)) + 1]
        n = np.diff(np.r_[start, len(h)])
        own = np.flatnonzero(np.repeat(np.minimum.reduceat(root, start) < np.maximum.reduceat(root, start), n))
        follow = np.repeat(start + n, n)[own] - own - 1
        rest = _at_least(least * size) - 1
        upto = np.cumsum(follow)
        for lo in range(0, int(upto[-1]) if len(upto) else 0, _PAIRS):
            hi = min(lo + _PAIRS, int(upto[-1]))
            p, q = np.searchsorted(upto, lo, "right"), np.searchsorted(upto, hi, "left") + 1
            before = upto[p:q] - follow[p:q]
            count = np.minimum(upto[p:q], hi) - np.maximum(before, lo)
            i = np.repeat(own[p:q], count)
            j = np.arange(lo, hi) + np.repeat(own[p:q] + 1 - before, count)
            can = (root[i] != root[j]) & (size[i] > rest[j])
            if share > 1:
                can &= _chosen(ids[i], ids[j], share)
            i, j = i[can], j[can]
            if len(i):
                need = _at_least(least / (1 + least) * (size[i].astype(np.int64) + size[j])) - np.maximum(rest[i], rest[j])
                pairs = np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), need], 1)
                found, times = np.unique(pairs, axis=0, return_counts=True)
                a, b, need = (pa.array(np.ascontiguousarray(found[:, k])) for k in range(3))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(times.astype(np.int64)), need], ["a", "b", "n", "need"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each a of a batch (a, b, n, need), sorted by a: the others are lists."""
    for t in batches:
        first = np.flatnonzero(np.r_[True, np.diff(t.column("a").to_numpy()) != 0])
        upto = pa.array(np.r_[first, t.num_rows].astype(np.int32))
        lists = (pa.ListArray.from_arrays(upto, t.column(c).cast(kind)) for c, kind in (("b", pa.int64()), ("n", pa.int32()), ("need", pa.int32())))
        yield pa.RecordBatch.from_arrays([t.column("a").take(pa.array(first)), *lists], ["a", "b", "n", "need"])


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) that have n of need or more in all, of rows (a, b, n, need) as of _packed, sorted by a."""
    for t in sorted_groups(batches, "a"):
        t = t.combine_chunks()
        a = np.repeat(t.column("a").to_numpy(), pc.list_value_length(t.column("b")).to_numpy())
        b, n, need = (pc.list_flatten(t.column(c)).to_numpy() for c in ("b", "n", "need"))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)])
        own = first[np.add.reduceat(n[order], first) >= need[order][first]]
        yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], ["a", "b"])


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, of equal or null ones
    that with the smallest key of doc_id, source and text. Rows with a null doc_id go if their group
    has another; of rows with the same doc_id, source and text one stays.

    Two texts are near-duplicates if their sets of ``shingle``-word shingles, in lower case, have a
    Jaccard similarity of ``similarity`` or more; a group is all that such pairs connect. Every pair
    that is linked has been compared exactly, and no pair is lost. What is compared at first:

    * texts whose fingerprints differ in at most 3 bits, along the forests of this module's grid join;
    * texts of one fingerprint, with the first of them;
    * texts with a set of section fingerprints in common, each with LEADS of those that have that set,
      if their own fingerprints differ in at most WIDE bits. A text of SECTIONS sections has 15 sets.

    These join nearly all. What they leave out is found by an exact way: in one order of all shingles,
    sets of that similarity share some of their first (``rarest``), so all texts of different groups
    that share as many as they have to, by their sizes, are compared too. One in EARLY of these pairs is
    compared with the first ones, so that groups of many similar texts are joined before the others are
    made. That leaves the square of the groups that share a shingle which is rare in each of their texts
    without being joined.

    Null texts are as empty ones, and all texts without words are equal. An empty table gives an empty
    result. Other columns stay."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    known = ("doc_id", "source", text, F.col("doc_id").isNull(), F.col("source").isNull())
    half = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), *known)), 16, "0")
    rows = docs.withColumn("_key", F.unhex(F.concat(half(0), half(1))))  # 128 bits, for no two of very many rows may meet
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_key").alias("key"))
    plain = rows.select(F.col("_key").alias("key"), text.alias("text"))
    sketched, sketch_path = save(_sketches(plain, shingle, similarity, _frequent(plain, shingle)), "sketches")
    ids = rows.select(first.alias("row"), "_key").distinct()
    best = ids.join(sketched.select("key", "same").distinct(), ids["_key"] == F.col("key")).groupBy("same").agg(F.min("row").alias("row"))
    one = sketched.withColumnRenamed("same", "_same").dropDuplicates(["key"])
    classes, _ = save(
        best.join(one, (F.col("row.key") == one["key"]) & (F.col("same") == one["_same"])).select(F.monotonically_increasing_id().alias("id"), "row", "fp", "parts", "size", "rare"), "texts"
    )
    # sets of sections, each with its first text
    one = F.transform("parts", lambda x: F.array(x))
    sets = F.aggregate("parts", F.array(F.array().cast("array<bigint>")), lambda done, x: F.concat(done, F.transform(done, lambda y: F.concat(y, F.array(x)))))
    sets = F.when(F.size("parts") > 0, F.slice(sets, 2, F.size(sets) - 1)).otherwise(one)
    of = classes.select("id", "fp", F.explode(F.transform(sets, lambda x: F.xxhash64(x))).alias("set"))
    leads = F.array_distinct(F.array(*(F.min_by(F.struct("id", "fp"), F.xxhash64("id", F.lit(k))) for k in range(LEADS))))
    least, least_path = save(of.groupBy("set").agg(leads.alias("leads"), F.count("*").alias("n")).where("n > 1").select("set", F.explode("leads").alias("lead")), "sets")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= WIDE
    shared = of.join(least, "set").where((F.col("id") != F.col("lead.id")) & near).select(F.col("lead.id").alias("a"), F.col("id").alias("b"))
    # close fingerprints, each by its first text, and texts of one fingerprint
    by_fp, fp_path = save(classes.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    ends = links(by_fp.select("fp"))
    for c in ("a", "b"):
        ends = ends.join(by_fp.select(F.col("fp").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    alike = classes.select("fp", F.col("id").alias("b")).join(by_fp.withColumnRenamed("id", "a"), "fp").where("a <> b").select("a", "b")

    def linked(met: DataFrame) -> DataFrame:
        """Of pairs that meet, those that are similar."""
        pairs, pairs_path = save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        # texts of those pairs only, then the pairs with both of them
        wanted = classes.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi").select("id", F.col("row.key").alias("_key"))
        texts, texts_path = save(rows.select("_key", text.alias("t")).join(wanted, "_key").select("id", "t").dropDuplicates(["id"]), "compared")
        release(spark)
        sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
        found, _ = save(_similar(sides, shingle, similarity), "links")
        drop(spark, pairs_path, texts_path)
        return found

    def meeting(of: DataFrame, share: int) -> DataFrame:
        """Pairs of texts with different roots that share enough of the rarest shingles, of one in share pairs."""
        sharing = of.select("size", "id", "root", F.explode("rare").alias("h")).select("h", "size", "id", "root")
        run = tidied(lambda batches: _packed(_sharing(batches, similarity, share)))
        met = sharing.repartition("h").sortWithinPartitions("h", "size", "id").mapInArrow(run, "a bigint, b array<bigint>, n array<int>, need array<int>")
        return met.repartition("a").sortWithinPartitions("a").mapInArrow(tidied(_enough), "a bigint, b bigint")

    early = meeting(classes.withColumn("root", F.col("id")), EARLY)
    roots = connected_components(linked(shared.unionByName(ends).unionByName(alike).unionByName(early))).withColumnRenamed("node", "id")
    drop(spark, sketch_path, least_path, fp_path)
    named, _ = save(classes.select("id", "row", "size", "rare").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "groups")
    # the rest, by the rarest shingles
    rest = linked(meeting(named, 1))
    for c in ("a", "b"):
        rest = rest.join(named.select(F.col("id").alias(c), F.col("root").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    joined = connected_components(rest.select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    named = named.select("root", "row").join(joined, "root", "left").select(F.coalesce("whole", "root").alias("root"), "row")
    keep = named.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("_key"))
    out = rows.join(keep, "_key", "left_semi")
    count = rows.agg(F.count("*").alias("n"), F.count_distinct("_key").alias("d")).first()
    return (out if count["n"] == count["d"] else out.dropDuplicates(["_key"])).drop("_key")
