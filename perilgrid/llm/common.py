"""Helpers that the training-data operators share: scratch tables, Arrow mapping, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that count as white space wherever words are taken; bytes.split() uses the same set.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, tuple[SparkSession, str]] = {}
_kept: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is
    unset (a local test) a folder under the machine's temporary folder is set instead."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/perilgrid-{uuid.uuid4().hex[:12]}/{name}"
    _scratch[path] = (spark, path)
    return path


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again, so that lineage ends there and a lost
    executor costs no recomputation. Returns the table and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _scratch.pop(path, None)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in list(_scratch.values()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone before
            return


def kept(f: Callable) -> Callable:
    """f, an lru_cache, which a worker keeps for later tasks of the same module only."""
    _kept[f.__module__] = f.cache_clear
    return f


def forget(but: str) -> None:
    """Empties the caches of all modules but one."""
    for module, clear in _kept.items():
        if module != but:
            clear()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, who is kept for later tasks, gives back the memory that it no longer uses. What
    other modules' tasks have left in its caches goes first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(run.__module__)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return wrapped


def utf8(col: pa.Array) -> list[bytes | None]:
    """The values of a text column as UTF-8 bytes, without decoding them."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def text_batches(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Slices of a batch whose texts hold at most most_bytes together; one longer text stands alone."""
    texts = utf8(batch.column(column))
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most_bytes:
            yield start, i, texts[start:i]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts), texts[start:]


def text_slices(batch: pa.RecordBatch, columns: list[str], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, without copies, whose texts in the columns hold at most most_bytes together; a row
    with more stands alone."""
    upto = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    start = 0
    while start < batch.num_rows:
        held = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, held + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Of rows sorted by key: tables that hold whole groups only, a batch's worth at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[len(k) - 1]
        if held and held[-1].column(key)[0] == last and k[0] == last:
            held.append(b)  # one group goes on through the whole batch
            continue
        keys = k.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        held.append(b.slice(0, cut))
        t = pa.Table.from_batches([x for x in held if x.num_rows] or [b.slice(0, 0)])
        if t.num_rows:
            yield t
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge in edges(a, b); root is the smallest node of
    its component. Alternating large-star and small-star steps (Kiveris et al., 2014): each is an
    aggregate that Spark combines before the shuffle and a join whose hot keys AQE splits, so a
    hub with a third of all edges does not meet in one task (the least neighbours are written first,
    for a side that comes straight from an aggregate can't be split). Nothing but two counts reaches
    the driver. Each round's edges are written to the shared folder. Nulls link nothing. Raises if
    ``most_rounds`` aren't enough; rounds grow with the logarithm of the longest path."""
    spark = edges.sparkSession
    e, path = save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for k in range(most_rounds + 1):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        if k == most_rounds:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = save(large, "large")
        low, least_path = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = save(small, "edges")
        drop(spark, path, low_path, large_path, least_path)
        e, path = new, new_path
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
