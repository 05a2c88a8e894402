"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, pieces, simhash, substring, tokens, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("key")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents")).drop("rid")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_warc, op3_mixing, op4_embedding_dedup, op5_chat, op6_simhash, op7_substring, op8_ann, op9_token_counts, op10_pieces)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_OP3 = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE '=' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT) >> 24 AS bucket
  FROM documents),
s AS (
  SELECT key, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY key),
r AS (
  SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / weight AS per_weight,
         (sum(source_size) OVER () * 1.5::DOUBLE
           - coalesce(sum(source_size * 2) OVER (ORDER BY (source_size * 2)::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY (source_size * 2)::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s),
l AS (SELECT level FROM r WHERE level * weight < cap ORDER BY per_weight, key LIMIT 1),
g AS (
  SELECT key, source_size,
         CASE WHEN (SELECT level FROM l) IS NULL OR cap <= (SELECT level FROM l) * weight THEN cap::DOUBLE ELSE (SELECT level FROM l) * weight END AS target
  FROM r),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM g),
b AS (SELECT key, bucket, sum(size)::BIGINT AS words FROM d GROUP BY key, bucket),
u AS (SELECT *, sum(words) OVER (PARTITION BY key ORDER BY bucket)::BIGINT AS upto FROM b),
f AS (
  SELECT u.key, u.bucket,
         u.upto <= c.target - c.copies * c.source_size
         OR (u.upto - u.words <= c.target - c.copies * c.source_size
             AND u.upto - (c.target - c.copies * c.source_size) < c.target - c.copies * c.source_size - (u.upto - u.words)) AS extra
  FROM u JOIN c USING (key))
SELECT d.doc_id, d.size, c.source_size, c.target,
       ((c.copies + CASE WHEN c.copies < 2 AND f.extra THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN c USING (key) JOIN f ON f.key = d.key AND f.bucket = d.bucket
"""

_OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM t),
x AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
         sum(8 + 8 + 8 + length(replace(replace(role, '\', '\e'), '<', '\l')) + length(replace(replace(text, '\', '\e'), '<', '\l')))::BIGINT AS formatted_chars,
         regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY k), 's?(ua)+') AS valid
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM x
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS w
  FROM d, unnest(generate_series(1, len(words) - 49)) AS g(i)),
m AS (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT w.doc_id, i + k AS i FROM w JOIN m USING (w), unnest(generate_series(0, 49)) AS g(k) WHERE m.least < w.doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.9),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT a, count(*)::BIGINT AS n_links FROM e GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(c.least, m.vec_id)) AS component_id,
       m.vec_id = least(m.vec_id, coalesce(c.least, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN k ON k.a = m.vec_id LEFT JOIN c ON c.a = m.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator and runs on whole tables. The others are tested
    against brute force: op1 (a learned model), op2 (SHA-1 in base32), op6 (XXH64), op8 (approximate
    by design), op9 and op10 (tokenizers) and the pipeline, whose stages hold them."""
    return {"op3_mixing": _OP3, "op4_embedding_dedup": _OP4, "op5_chat": _OP5, "op7_substring": _OP7}
