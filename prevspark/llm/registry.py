"""The queries of the training-data operators and the DuckDB SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevspark.llm import chat, decontaminate, lines, mixing, secrets, sharding, simhash, tokens, topk, toxicity
from prevspark.llm.common import scratch, table


def tokenizer_path() -> str:
    """The byte-level vocabulary; read from where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from wavelet-matrix shards."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes the template, formatted and read back."""
    quoted = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = lambda n, role: F.struct(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(quoted).alias("text")
    )
    extra = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    return chat.round_trip(rows.unionByName(extra))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, with the item and the alignment's score."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows by integer inner product of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat or nearly repeat an earlier line."""
    return lines.report(table(spark, sf_dir, "documents"), whole=True)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, by virtual slots and their bytes."""
    return sharding.sharded(table(spark, sf_dir, "documents"), map_path=scratch(spark, "slot_maps"))


QUERIES = {
    "op1_wavelet_tokens": op1_wavelet_tokens,
    "op2_chat": op2_chat,
    "op3_secrets": op3_secrets,
    "op4_mix": op4_mix,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_topk": op7_topk,
    "op8_toxicity": op8_toxicity,
    "op9_lines": op9_lines,
    "op10_shard": op10_shard,
}

ORACLES = {
    "op2_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), k AS (
  SELECT conv_id, CAST(max(CASE WHEN contains(text, '### ') OR contains(text, '</turn>') OR contains(role, '### ')
    OR contains(role, '</turn>') OR contains(role, ': ') THEN 1 ELSE 0 END) AS INTEGER) AS escape_level FROM c GROUP BY conv_id
), t AS (
  SELECT c.*, escape_level, CASE WHEN escape_level = 0 THEN text
    ELSE replace(replace(replace(replace(text, '\\', '\\e'), '### ', '\\h'), '</turn>', '\\t'), ': ', '\\c') END AS shown
  FROM c JOIN k USING (conv_id)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(16 + sum(14 + length(role) + length(shown)) AS BIGINT) AS formatted_chars, any_value(escape_level) AS escape_level
FROM t GROUP BY conv_id
""".replace("\\\\", "\\"),
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
