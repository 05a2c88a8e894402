"""A corpus pipeline of five stages over documents: language ID, SimHash near-dedup, substring dedup,
mixing to target weights, SentencePiece encoding. Each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.llm import langid, mixing, pieces, simhash, substring
from perilgrid.llm.common import WORD_PATTERN, save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected if the posterior of its language is below this.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; lang becomes the predicted one. Rejected: null texts,
    texts without a letter, and those whose best language is not likelier than all others together."""
    d = docs.select(*COLUMNS).withColumn("held_out", langid.held_out())
    labelled = d.where("not held_out and doc_id is not null").select(F.col("doc_id").alias("id"), "text", "lang")
    found = langid.predict(d, langid.train(labelled), ["doc_id", "text", "source", "n_chars"])
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest doc_id. Near-duplicates have
    sets of five-word shingles with a similarity of 0.8 or more."""
    return simhash.representatives(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in passages of 50 words or more that an earlier document has too; a document
    of which no word is left goes. n_chars follows a changed text."""
    d = docs.select(*COLUMNS)
    cut = substring.dedup(d.select("doc_id", "text"), with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "rid"])
    changed = cut.select("doc_id", "rid", "kept_text")
    rows = d.withColumn("rid", F.xxhash64("doc_id", F.col("text").cast("string"))).join(changed, ["doc_id", "rid"], "left")
    text = F.coalesce("kept_text", "text")
    n = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))
    out = rows.where("kept_text is null or kept_text <> ''").select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))
    return out.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so that sources come near their target weights: some not at all, some twice,
    as repeated rows."""
    d = docs.select(*COLUMNS)
    taken = mixing.mix(d).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), (F.col("taken") / F.col("size")).cast("int").alias("copies")).distinct()
    out = d.where(F.col("text").rlike(WORD_PATTERN)).join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (mixing.source_key("source") == F.col("_key")))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of each text into pieces, as digests; every text is decoded again."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
