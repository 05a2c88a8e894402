"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word by the character
n-grams of the longest order of which any is known (5, then 4, ... 1). The model is learned from a
bounded sample of labelled documents and broadcast; its size is bounded by its parameters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidied

_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
_CACHE = 50_000


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: list[dict[str, int]]  # by order, longest first
    logp: np.ndarray  # a row for each word and n-gram, a column for each language

    def rows(self, word: str) -> tuple[int, ...]:
        """The rows of an unseen word's known n-grams, of the longest order that has any."""
        padded = f"<{word}>"
        n = len(self.grams)
        for known in self.grams:
            found = tuple(known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known)
            if found:
                return found
            n -= 1
        return ()

    def predict(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> tuple[str, float]:
        counts = Counter(_LETTERS.findall((text or "").lower()))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        at: list[int] = []
        weight: list[float] = []
        for word, n in counts.items():
            row = self.words.get(word)
            if row is not None:
                at.append(row)
                weight.append(n)
                continue
            rows = cache.get(word)
            if rows is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                rows = cache[word] = self.rows(word)
            if rows:
                at += rows
                weight += [n / len(rows)] * len(rows)
        score = self.prior.copy()
        if at:
            score += np.asarray(weight) @ self.logp[at]
        best = int(np.argmax(score))
        return self.langs[best], float(1 / np.exp(score - score[best]).sum())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.update((lang, w) for w in _LETTERS.findall((text or "").lower()))
        if counts:
            langs, words = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def train(labelled: DataFrame, docs_per_lang: int = 1500, words_per_lang: int = 20_000, orders: int = 5, grams_per_order: int = 60_000, alpha: float = 0.1) -> Model:
    """Learns from labelled(id, text, lang). Of each language about docs_per_lang documents are
    taken, by a hash of the id; of its words the words_per_lang most frequent; of each order at most
    grams_per_order n-grams, the most frequent. What reaches the driver is bounded by these."""
    labelled = labelled.where("lang is not null")
    share = {r["lang"]: docs_per_lang / r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], np.zeros(0), {}, [], np.zeros((0, 0)))
    langs = sorted(share)
    chosen = F.lit(False)
    for lang in langs:
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < math.ceil(share[lang] * 1e6)))
    counts = labelled.where(chosen).select("lang", "text").mapInArrow(tidied(_count_words), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= words_per_lang).collect():
        words.setdefault(r["word"], {})[r["lang"]] = r["n"]
    at = {lang: i for i, lang in enumerate(langs)}
    blocks, index = [], 0

    def block(found: dict[str, np.ndarray]) -> dict[str, int]:
        nonlocal index
        keys = sorted(found)
        m = np.array([found[k] for k in keys]).reshape(-1, len(langs)) + alpha
        blocks.append(np.log(m / m.sum(0)))
        index += len(keys)
        return {k: index - len(keys) + i for i, k in enumerate(keys)}

    def vector(n: dict[str, int]) -> np.ndarray:
        v = np.zeros(len(langs))
        for lang, k in n.items():
            v[at[lang]] = k
        return v

    vectors = {w: vector(n) for w, n in words.items()}
    known, grams = block(vectors), []
    for order in range(orders, 0, -1):
        found: dict[str, np.ndarray] = {}
        for w, v in vectors.items():
            padded = f"<{w}>"
            for i in range(len(padded) - order + 1):
                g = padded[i : i + order]
                found[g] = found[g] + v if g in found else v
        if len(found) > grams_per_order:
            found = dict(sorted(found.items(), key=lambda x: (-x[1].sum(), x[0]))[:grams_per_order])
        grams.append(block(found))
    prior = np.array([share[x] for x in langs])
    prior = np.log(prior.min() / prior)  # only to settle texts without evidence
    return Model(langs, prior - prior.max(), known, grams, np.concatenate(blocks) if blocks else np.zeros((0, len(langs))))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs with lang_pred and score; docs also has the column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            found = [m.predict(t, cache) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(tidied(run), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text.

    The model is learned from the rows with a language whose crc32(doc_id as text) mod 5 is not 0.
    lang_pred is ``und`` with score 0 where the text is null or has no letter, and where nothing
    could be learned; a text in letters that the model never saw gets the most frequent language.
    score is the posterior of lang_pred. Ties go to the smaller language name. Null doc_id: not held
    out, and never learned from. Repeated rows are predicted alike. Other columns are not read."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(id_col).alias("held_out"))
    model = train(d.where("not held_out and doc_id is not null").select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict(d.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
