"""Corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop benchmark leaks, redact
secrets, encode. Every stage takes and returns the columns of documents, but the last, which returns tokens.

Nulls in any column pass through: a null text is never toxic, duplicate, leaked or secret and encodes to no ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hazeframe.llm import bpe, decontaminate, jaccard_join, secrets, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """CRF trained on this stage's own labelled rows; documents with a score of 0.5 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard 0.8 or more, transitively; the smallest doc_id of each group stays."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of similarity 0.8 or more to a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by [SECRET]; the documents stay."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), output=True).drop("decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
ORACLE_SQL = None  # SQL cannot express the model, the SimHash search or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
