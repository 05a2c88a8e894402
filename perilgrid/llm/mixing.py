"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a 60-bit hash. A source takes floor(target / size) whole copies of all its
documents and, for the rest of its target, those below a hash threshold. The threshold is found
without sorting: words are summed by source and hash bucket (the hash's first 12 bits), the bucket
in which the running sum passes the rest is the boundary, and only that bucket's documents are summed
again, by the next 12 bits, three levels in all. Thresholds nest: a smaller target takes a subset of
the documents. A histogram has at most 4096 rows a source, and tasks sum their own rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Bytes of rules (one a source) that are broadcast; larger tables of rules are joined by shuffle.
MOST_BROADCAST = 16 << 20
MOST_REPEATS = 2
BITS, LEVELS, TOTAL_BITS = 12, 3, 60


def _hash(id_col: Column) -> Column:
    """60 bits of the MD5 of an id's text; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bucket(level: int) -> Column:
    """The hash's first level * BITS bits."""
    return F.shiftright("hash", TOTAL_BITS - BITS * level)


def source_key(source_col: str) -> Column:
    """A text that stands for a source, null or not."""
    source = F.col(source_col).cast("string")
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("="), source))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, size, hash): key is a text that stands for the source, null or not."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source_key(source_col).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        _hash(F.col(id_col)).alias("hash"),
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(key, source_size, target) of by_source(key, source_size). Weights go by code point, null
    last ('=' is below 'n'). Targets are share * total in proportion to the weights, none above most
    times its source: in order of that limit per unit of weight, a source stops at it if what is
    left for the others, shared by weight, would exceed it. A row per source: a small table."""
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    limited = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(order), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    stepped = limited.withColumn("level", left / left_weight).withColumn("free", F.col("level") * F.col("weight") < F.col("limit"))
    # from the first free source on, all share one level
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "key", "level"))).over(everything)["level"]
    target = F.when(level.isNull() | (F.col("limit") <= level * F.col("weight")), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    return stepped.select("key", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, size, source_size, target, taken) of every row of docs.

    size: words in the text (null: 0). taken: 0, 1 or 2 times size, so that a source's taken words
    are as near its target as the documents at its threshold allow. Reruns agree, for the hash is of
    the doc_id; rows with one doc_id are taken alike. Null text or no words: size and taken 0. Null
    source: a source of its own, the last. A source without words has target 0. Other columns aren't
    read; an empty table gives an empty result."""
    table, _ = save(sizes(docs, id_col, text_col, source_col), "sizes")
    first, _ = save(_histogram(table, 1), "histogram")
    goal, _ = save(targets(first.groupBy("key").agg(F.sum("words").alias("source_size"))), "targets")
    held = goal.agg(F.sum(F.octet_length("key") + 100).alias("n")).first()["n"] or 0
    small = F.broadcast if held <= MOST_BROADCAST else (lambda x: x)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # prefix: buckets below it (in its level's bits) are taken, it itself is to be refined
    edge = goal.select("key", whole.alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")).where("source_size > 0")
    part = first
    for level in range(1, LEVELS + 1):
        if level > 1:  # of the boundary bucket's documents alone
            inside = table.join(small(edge.where("words > 0").select("key", "prefix")), "key").where(_bucket(level - 1) == F.col("prefix"))
            part = _histogram(inside, level)
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("b"))
        part = part.join(small(edge.select("key", "copies", "left")), "key").withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("words"))
        # the boundary: the first bucket whose running sum exceeds what is left; none if all fit
        least = F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", "below", "words")))
        found = part.groupBy("key").agg(least.alias("x"), F.max("upto").alias("all"), F.max("b").alias("last"))
        edge = edge.select("key", "copies", "left", F.col("prefix").alias("old")).join(small(found), "key", "left").select(
            "key", "copies",
            (F.col("left") - F.coalesce("x.below", "all", F.lit(0))).alias("left"),
            F.coalesce("x.b", F.col("last") + 1, F.shiftleft("old", BITS)).alias("prefix"),
            F.coalesce("x.words", F.lit(0)).alias("words"),
        )
        edge, _ = save(edge, "edge")
    # the last boundary bucket as a whole, if that comes nearer
    limit = F.col("prefix") + F.when(F.col("words") - F.col("left") < F.col("left"), 1).otherwise(0)
    rule, _ = save(goal.join(small(edge.select("key", "copies", limit.alias("limit"))), "key", "left"), "rule")
    extra = F.when((F.col("copies") < MOST_REPEATS) & (_bucket(LEVELS) < F.col("limit")), 1).otherwise(0)
    taken = F.coalesce((F.col("copies") + extra) * F.col("size"), F.lit(0)).cast("long")
    return table.join(small(rule), "key").select("doc_id", "key", "size", "source_size", "target", taken.alias("taken"))


def _histogram(docs: DataFrame, level: int) -> DataFrame:
    """(key, b, words): words by source and the hash's first level * BITS bits."""
    return docs.groupBy("key", _bucket(level).alias("b")).agg(F.sum("size").alias("words"))
