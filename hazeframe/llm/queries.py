"""Registry of the corpus queries; __spark_entry__.py adds them when this folder is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import line_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_difference_cover_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op2_rendezvous_shards(spark, sf_dir):
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


def op3_weak_supervision_pii(spark, sf_dir):
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op4_content_addressed_tokens(spark, sf_dir):
    from .common import scratch
    from .token_store import checked, write_store

    write_store(_table(spark, sf_dir, "documents"), path := scratch(spark), _tokenizer(), end_id=2)
    return checked(spark, path)


def op5_token_group_jaccard(spark, sf_dir):
    from .jaccard_join import group_documents

    return group_documents(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_simhash_decontamination(spark, sf_dir):
    from .decontaminate import find_contamination

    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_forced_boundary_bpe(spark, sf_dir):
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), _tokenizer())


def op8_markov_secrets(spark, sf_dir):
    from .secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


def op9_crf_toxicity(spark, sf_dir):
    from .toxicity import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


def op10_nn_descent_dedup(spark, sf_dir):
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_trie_importance(spark, sf_dir):
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_harmonic_runs(spark, sf_dir):
    from .periodic_runs import find_runs

    return find_runs(_table(spark, sf_dir, "documents"), plant=True)


def op13_line_dedup(spark, sf_dir):
    from .line_dedup import drop_common_lines

    return drop_common_lines(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_difference_cover_dedup, op2_rendezvous_shards, op3_weak_supervision_pii, op4_content_addressed_tokens, op5_token_group_jaccard, op6_simhash_decontamination, op7_forced_boundary_bpe, op8_markov_secrets, op9_crf_toxicity, op10_nn_descent_dedup, op11_trie_importance, op12_harmonic_runs, op13_line_dedup)}

ORACLE_SQL: dict[str, str] = {"op13_line_dedup": line_dedup.ORACLE_SQL}
