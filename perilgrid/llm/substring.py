"""Substring dedup with a log-structured index of window fingerprints.

Every window of 50 words has a *leader*: the least hash among its 8-word grams. Consecutive windows
of a document with one leader form a *run* (about 22 windows), stored as one row: the leader, a
digest of all words that the run covers, the document and the place. Equal windows have equal leaders, so
duplicates can only lie in runs with a common leader:

* runs with equal leader and equal words: all windows of the later document's run are duplicates;
* runs with equal leader and different words (the edge of a shared passage): their windows are
  taken one by one, and equal windows are found by digest. Only the first document of each class of
  equal runs takes part, so a passage that many documents share isn't compared pair by pair.

The index keeps, for each class, its first run, in immutable sorted tables. A batch of new
documents is merge-joined with each table and its new classes become one more table. If there are
more than ``fanout`` tables when a batch comes, they are merged into one first. Leaders only find candidates. Each match is verified
on 128 bits of BLAKE2b of the words themselves, joined by one space, so no chosen or chance collision
of the fast hashes removes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, release, save, text_batches, tidied, utf8

WINDOW, GRAM = 50, 8
CHUNK = 1 << 18
_M = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse modulo 2^64, at least n of each."""
    if k not in _powers or len(_powers[k][0]) < n:
        n = max(n, CHUNK + 1)
        both = []
        for b in (_BASE[k], pow(_BASE[k], -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 2 * CHUNK:  # for one very long text only; not kept
            return both[0], both[1]
        _powers[k] = (both[0], both[1])
    return _powers[k]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * inverse[start])


def _prefix(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    p, inverse = _power(k, len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=s[1:])
    return s, inverse


@dataclass
class Words:
    """The words of some texts, each text rewritten with one space between words."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # the index of each text's first word, and one more at the end

    def hashes(self) -> np.ndarray:
        s, inverse = _prefix(_BYTE[np.frombuffer(self.data, np.uint8)], 0)
        return _mix(_spans(s, inverse, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def digests(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        """Digests of n[i] words of one text from word at[i] on."""
        view, blake = memoryview(self.data), hashlib.blake2b
        spans = zip(self.start[at].tolist(), self.end[at + n - 1].tolist())
        return pa.array([blake(view[a:b], digest_size=16).digest() for a, b in spans], pa.binary())


def words_of(texts: list[bytes | None]) -> Words:
    plain = [b" ".join((t or b"").split()) for t in texts]
    joined = b"\n".join(plain)
    data = np.frombuffer(joined, np.uint8)
    edge = np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(t) + 1 for t in plain])
    return Words(joined, start, end, np.r_[0, np.searchsorted(start, ends)])


def _leaders(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows, and their leaders."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s, inverse = _prefix(words, 1)
    at = np.arange(n - GRAM + 1)
    m, span = _spans(s, inverse, at, at + GRAM), 1
    most = WINDOW - GRAM + 1
    while 2 * span <= most:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if most > span:
        m = np.minimum(m[: len(m) - (most - span)], m[most - span :])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    return start, m[start]


def runs_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each run: the text's index, first window's word within the text, number of windows, leader, content."""
    words = words_of(texts)
    first = words.first
    start, lead = _leaders(words.hashes(), first)
    owner = np.searchsorted(first, start, side="right") - 1
    new = np.flatnonzero(np.r_[len(start) > 0, (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])] if len(start) else np.zeros(0, bool))
    n = np.diff(np.r_[new, len(start)])
    i0 = start[new]
    return owner[new], i0 - first[owner[new]], n, lead[new], words.digests(i0, n + WINDOW - 1)


def runs(docs: DataFrame) -> DataFrame:
    """(lead, content, doc_id, rid, at, n) of every run of docs(doc_id, rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, texts in text_batches(b, "text", CHUNK):
                i, at, n, lead, content = runs_of(texts)
                if len(i):
                    take = pa.array(i + lo)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lead.view(np.int64)), content, b.column("doc_id").take(take), b.column("rid").take(take), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                        ["lead", "content", "doc_id", "rid", "at", "n"],
                    )

    return docs.mapInArrow(tidied(run), f"lead bigint, content binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid bigint, at int, n int")


def _windows(docs: DataFrame) -> DataFrame:
    """(w, doc_id, rid, at) of each window of the runs listed in docs(doc_id, rid, text, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, opens = utf8(b.column("text")), b.column("open").to_pylist()
            for i, (t, spans) in enumerate(zip(texts, opens)):
                words = words_of([t])
                at = np.unique(np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in spans]))
                at = at[at + WINDOW <= len(words.start)]
                w = words.digests(at, np.full(len(at), WINDOW))
                own = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([w, b.column("doc_id").take(own), b.column("rid").take(own), pa.array(at.astype(np.int32))], ["w", "doc_id", "rid", "at"])

    return docs.mapInArrow(tidied(run), f"w binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid bigint, at int")


def covered(n_words: int, spans: list[dict] | None) -> np.ndarray:
    """Which words lie in a window that starts in one of the spans."""
    change = np.zeros(n_words + 1, np.int64)
    for x in spans or ():
        change[min(x["at"], n_words)] += 1
        change[min(x["at"] + x["n"] + WINDOW - 1, n_words)] -= 1
    return np.cumsum(change[:-1]) > 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, text): rid tells rows with one doc_id and different texts apart; a document is
    known by both."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rid"), text.alias("text"))


@dataclass
class SubstringIndex:
    """Classes of runs seen so far, as immutable tables sorted by leader. Batches come in ascending
    order of doc_id: a window counts as a duplicate only if a smaller doc_id has it too."""

    spark: SparkSession
    fanout: int = 4
    tables: list[str] = field(default_factory=list)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, classes: DataFrame) -> str:
        return save(classes.repartitionByRange("lead").sortWithinPartitions("lead", "content"), "index")[1]

    def add(self, batch: DataFrame, corpus: DataFrame) -> DataFrame:
        """Indexes batch(doc_id, rid, text) and returns (doc_id, rid, spans): for each of its documents with
        duplicates, the windows (first word, number) that an earlier document has too. corpus: all
        documents so far with this batch, to verify against."""
        if len(self.tables) > self.fanout:
            self.compact()
        known = batch.where("doc_id is not null")
        mine, mine_path = save(runs(known), "runs")
        first = F.struct("doc_id", "rid", "at", "n")
        fresh, fresh_path = save(mine.groupBy("lead", "content").agg(F.min(first).alias("first")), "fresh")
        # one merge join with each table, for the classes that have a leader of this batch
        leaders = fresh.select("lead").distinct()
        near = fresh.limit(0)
        for t in self.tables:
            near = near.unionByName(self._read(t).join(leaders.hint("merge"), "lead", "left_semi"))
        near, near_path = save(near, "near")
        old = near.select("lead", "content", F.col("first.doc_id").alias("old"))
        classes = fresh.join(old, ["lead", "content"], "left").withColumn("least", F.least("first.doc_id", "old")).withColumn("new", F.col("old").isNull()).drop("old")
        classes, classes_path = save(classes, "classes")
        whole = mine.join(classes.select("lead", "content", "least"), ["lead", "content"]).where("least < doc_id").select("doc_id", "rid", "at", "n")
        new = classes.where("new").select("lead", "content", "first")
        self.tables.append(self._write(new))
        both = near.select("lead", "first.doc_id", F.lit(False).alias("fresh")).unionByName(new.select("lead", "first.doc_id", F.lit(True).alias("fresh")))
        leads = both.groupBy("lead").agg(F.count("*").alias("k"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("fresh").alias("fresh")).where("k > 1 and lo < hi and fresh")
        leads, leads_path = save(leads.select("lead"), "leaders")
        # of a class of an earlier batch one place tells its windows; a new one loses words at every place in its first document
        opening = new.join(leads, "lead", "left_semi").select("lead", "content", "first.doc_id")
        places = mine.join(opening, ["lead", "content", "doc_id"], "left_semi").select("doc_id", "rid", "at", "n")
        places = places.unionByName(near.join(leads, "lead", "left_semi").select("first.doc_id", "first.rid", "first.at", "first.n"))
        spans = F.collect_list(F.struct("at", "n"))
        opened = places.groupBy("doc_id", "rid").agg(spans.alias("open"))
        windows, windows_path = save(_windows(corpus.join(opened, ["doc_id", "rid"]).select("doc_id", "rid", "text", "open")), "windows")
        # written first, for Spark can split a join's hot keys only if neither side comes straight from an aggregate
        lowest = windows.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w", "least")
        lowest, lowest_path = save(lowest, "lowest")
        part = windows.join(lowest, "w").where("least < doc_id").select("doc_id", "rid", "at", F.lit(1).alias("n"))
        found, found_path = save(whole.unionByName(part).groupBy("doc_id", "rid").agg(spans.alias("spans")), "spans")
        drop(self.spark, mine_path, fresh_path, near_path, classes_path, leads_path, windows_path, lowest_path)
        return found

    def compact(self) -> None:
        """Merges all tables into one, keeping of each class the run of the smallest doc_id."""
        every = [self._read(p) for p in self.tables]
        union = every[0]
        for t in every[1:]:
            union = union.unionByName(t)
        new = self._write(union.groupBy("lead", "content").agg(F.min("first").alias("first")))
        drop(self.spark, *self.tables)
        self.tables = [new]


def _cut(docs: DataFrame, id_kind: str, with_text: bool) -> DataFrame:
    """The kept words of docs(doc_id, rid, text, spans), counted and hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(utf8(b.column("text")), b.column("spans").to_pylist()):
                words, total = (t or b"").split(), 0
                total = len(words)
                if spans:
                    gone = covered(total, spans)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                rows.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), (t if total == len(words) else kept) if with_text else None))
            cols = list(zip(*rows))
            arrays = [b.column("doc_id"), b.column("rid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])]
            names = ["doc_id", "rid", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[3], pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {id_kind}, rid bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return docs.mapInArrow(tidied(run), schema)


def _cuts(keys: DataFrame, batches: int) -> list:
    """At most batches - 1 ids that cut the documents into ranges of about equal numbers: quantiles of
    the 1000 distinct ids with the smallest hashes. They only say which batch a document comes in."""
    if batches < 2:
        return []
    some = keys.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("hash")).distinct().orderBy("hash", "doc_id").limit(1000)
    ids = sorted(r["doc_id"] for r in some.collect())
    return sorted({ids[k * len(ids) // batches] for k in range(1, batches)}) if ids else []


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, fanout: int = 1, with_text: bool = False) -> DataFrame:
    """(doc_id, rid, n_words, n_removed, kept_sha256[, kept_text]), a row for each row of docs.

    Removes every word that is covered by a window of 50 consecutive words whose word sequence also
    starts in a document with a smaller doc_id, all judged on the input. The documents are added to
    a log-structured index in ``batches`` ranges of doc_id, smallest first. kept_text is the text
    itself where nothing goes, else the kept words joined by one space.

    Texts are taken whole, however long. doc_id: of any type that can be ordered. Null text: no words. Null doc_id: nothing is removed and nothing else is for its sake. Rows with
    the same doc_id don't remove from each other, whether their texts are equal or not. Other
    columns are not read. An empty table gives an empty result."""
    spark = docs.sparkSession
    keys = keyed(docs, id_col, text_col)
    id_kind = keys.schema["doc_id"].dataType.simpleString()
    cuts = _cuts(keys, batches)
    index, results = SubstringIndex(spark, fanout), []
    for k in range(len(cuts) + 1):
        lo = F.lit(True) if k == 0 else F.col("doc_id") > F.lit(cuts[k - 1])
        hi = F.lit(True) if k == len(cuts) else F.col("doc_id") <= F.lit(cuts[k])
        batch = keys.where((lo & hi) | (F.col("doc_id").isNull() if k == 0 else F.lit(False)))
        spans = index.add(batch, keys.where(hi))
        results.append(save(_cut(batch.join(spans, ["doc_id", "rid"], "left"), id_kind, with_text), "cut")[0])
        release(spark)
    drop(spark, *index.tables)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
