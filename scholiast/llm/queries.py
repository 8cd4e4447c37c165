"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embeddings, lm_filter, oracles, quality_fm, simhash, substring_words, suffix_bytes, token_counts, toxicity
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_lm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_filter.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_fm.score(docs, quality_fm.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.dedup_words(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_suffix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_bytes.dedup_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, _tokenizer("byte_bpe_50k.json"), token_counts.fresh_cache(spark))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_lm_filter, op4_simhash, op5_quality, op6_substring_words, op7_embeddings, op8_decontaminate, op9_suffix_bytes, op10_token_counts)}
ORACLES: dict[str, str] = {
    "op6_substring_words": oracles.SUBSTRING_WORDS,
    "op7_embeddings": oracles.EMBEDDINGS,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_suffix_bytes": oracles.SUFFIX_BYTES,
}
