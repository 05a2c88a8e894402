"""Token counts by an exact length histogram: documents are aggregated by encoded length, and suffix
sums over the histogram answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, tidied

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that this public vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The code points that \s stands for in the pattern.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = re.compile(_BLANK + "{2000,}")


@kept
@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length(enc: tiktoken.Encoding, text: str | None) -> int:
    """The encoded length of a whole text; 0 for a null one. The pattern's matcher recurses over a run
    of white space, so one of 2000 signs or more is cut out where the pattern itself ends a piece: all
    of the run is one piece but its last sign, which goes with what follows, unless nothing does."""
    if not text:
        return 0
    n = at = 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    return n + len(enc.encode_ordinary(text[at:] if at else text))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): the encoded length of each whole text; 0 for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [length(enc, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(tidied(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many texts have each length. Each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, found = encoder(vocabulary), Counter()
        for b in batches:
            found.update(length(enc, t) for t in b.column(0).to_pylist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "n_tokens bigint, n_docs bigint")
    return found.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """What every context limit keeps, a row for each length that occurs (between two of them all
    figures but kept_tokens are those of the lower, and kept_tokens is linear).

    limit; n_docs: texts of just that length; longer_docs, longer_tokens: texts beyond it and their
    tokens; total_docs, total_tokens: of the whole corpus; kept_tokens: the total if every text is
    truncated at limit; share_docs: the share of texts that fit, so the quantile q of the lengths is
    the least limit with share_docs >= q. The histogram has a row for each distinct length, not for
    each document, so its running sums are one small task."""
    down = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    h = hist.select(
        F.col("n_tokens").alias("limit"),
        "n_docs",
        F.coalesce(F.sum("n_docs").over(down), zero).alias("longer_docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(down), zero).alias("longer_tokens"),
        F.sum("n_docs").over(everything).alias("total_docs"),
        F.sum(F.col("n_docs") * F.col("n_tokens")).over(everything).alias("total_tokens"),
    )
    return h.withColumn("kept_tokens", F.col("total_tokens") - F.col("longer_tokens") + F.col("longer_docs") * F.col("limit")).withColumn(
        "share_docs", (F.col("total_docs") - F.col("longer_docs")) / F.col("total_docs")
    )


def quantile(table: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the least length that at least the share q of the texts doesn't exceed."""
    return table.where(F.col("share_docs") >= q).agg(F.min("limit").alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """(kept_tokens): tokens left if every text is truncated at any limit, in the table or not."""
    row = F.max_by(F.struct("limit", "longer_docs", "longer_tokens", "total_tokens"), F.when(F.col("limit") <= limit, F.col("limit")))
    below = table.agg(row.alias("x"), F.max("total_docs").alias("docs"))
    x = F.col("x")
    return below.select(F.when(x.isNull(), F.col("docs") * limit).otherwise(x["total_tokens"] - x["longer_tokens"] + x["longer_docs"] * limit).alias("kept_tokens"))


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """context_table of all rows of docs. A null or empty text has 0 tokens and counts as a text; texts
    are encoded whole however long, long white space too (see length); repeated rows count each; other columns aren't read; an empty table gives no rows."""
    return context_table(histogram(docs, text_col, vocabulary))
