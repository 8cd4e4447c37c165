"""The corpus pipeline: quality filter, near-dedup, repeated bytes, benchmark passages, tokens.

Each stage is (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`. Nothing is cut short: each stage sees every row and every byte that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm import bpe, decontaminate, near_sets, quality_fm, suffix_bytes
from scholiast.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs and rk, a hash of the whole row: two rows share it only if they are equal in all columns."""
    nulls = [F.isnull(c) for c in COLUMNS]
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *nulls).alias("rk"))


def _where(keyed: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of keyed whose rk is in keep (rk, distinct)."""
    return keyed.join(keep.select(F.col("rk").alias("_rk")).hint("shuffle_hash"), F.col("rk") == F.col("_rk"), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the factorisation machine, fitted on this stage's input, scores 0.3 or more."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_fm.filter_documents(docs.select(*COLUMNS), model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more, links followed): that of
    smallest id, null ids last, and of several rows with that id the one of least row hash. Rows of one id in two groups are judged each by its own text.
    """
    keyed = _keyed(docs)
    groups = near_sets.near_duplicates(keyed.select("doc_id", "rk", "text"), size=5)
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "rk")).alias("best")
    kept = groups.groupBy("component").agg(best).select("best.rk")
    out = _where(keyed, kept)
    repeated = out.groupBy("rk").count().where("count > 1").limit(1).count()
    return (out.dropDuplicates(["rk"]) if repeated else out).select(*COLUMNS)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte that a string of 200 bytes starting elsewhere as well covers. What a cut leaves of a character is dropped."""
    return suffix_bytes.clean_documents(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate, each row by its own text."""
    keyed = _keyed(docs)
    flags = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark", "item_id", "text"), id_col="rk")
    return _where(keyed, flags.where("NOT contaminated").select(F.col("doc_id").alias("rk")).distinct()).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text and decodes it again: (doc_id, n_tokens, ids_sha256, decoded_sha256, exact)."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_bytes", repeated_bytes), ("benchmark", benchmark), ("tokens", tokens)]

#: No SQL: classifier, fingerprints and tokens aren't expressible. tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
