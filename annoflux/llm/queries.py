"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annoflux.llm import context_mixing, conversation_repair, decontaminate, hard_negatives, jaccard_join, language_id, media, pii, secret_scan, sentencepiece_wfst, substring_dedup, suffix_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip and the digest of the decoded text."""
    done = sentencepiece_wfst.encode_decode(_documents(spark, sf_dir).select("doc_id", "text"), sentencepiece_wfst.read_model())
    return done.select("doc_id", "n_tokens", "ids", "round_trip", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(_documents(spark, sf_dir), width=13, with_text=False)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir), alike=pii.ALIKE)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_strings(_documents(spark, sf_dir), with_text=False)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_as_media(_documents(spark, sf_dir), with_media=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents with the items that they leak."""
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k", "uid")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of embeddings; every fiftieth is an anchor, and every seventh bears the next label."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, relabelled, positives=5, negatives=3)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS own,
    CAST(list_sum(list_transform(list_zip(a.q, e.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id,
    positive_score, score AS negative_score FROM positive JOIN pairs USING (anchor_id)
WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh of the checksums of doc_id is held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return context_mixing.score(_documents(spark, sf_dir), held)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_language_id": op2_language_id,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_toxicity": op5_toxicity,
        "op6_pii": op6_pii,
        "op7_secrets": op7_secrets,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_media": op9_media,
        "op10_decontamination": op10_decontamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_context_mixing": op12_context_mixing,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11_SQL}
