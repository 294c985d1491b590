"""Corpus cleaning in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages but the last return the columns of ``documents``: toxic documents go, one document
of each near-duplicate component stays, leaks of the benchmark go, personal data is
generalised, and what is left is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annoflux.llm import decontaminate, jaccard_join, pii, sentencepiece_wfst, toxicity
from annoflux.llm.storage import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, whole; null and empty texts stay, repeated rows stay or go together."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the least id (nulls last), a repeated row once. Texts without words are no copies and stay."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark; null and empty texts leak nothing, repeated rows stay or go together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by its kind and disclosing words removed; null texts stay null."""
    return pii.sanitise(docs, alike=pii.ALIKE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with the pieces' ids and what they decode to; null texts have no pieces."""
    return sentencepiece_wfst.encode_decode(docs, sentencepiece_wfst.read_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", generalise_personal_data),
    ("sentencepiece", encode),
]

#: The stages learn weights and follow links of any length, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
