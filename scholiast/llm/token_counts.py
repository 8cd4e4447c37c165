"""Token counts through a digest cache.

A count is stored under (digest of the normalised content, digest of the tokenizer's version).
A run joins the corpus to the store, encodes one text of each digest that is missing, and appends
the new counts, so that copies inside a corpus and texts of earlier runs are never encoded twice.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, texts

#: So few missing digests (some 70 bytes each) are broadcast to the texts; more meet them by a shuffle of all texts.
FEW_MISSING = 20_000
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
#: The code points that Unicode lists as White_Space.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")


def version_of(path: str) -> str:
    """Digest of the tokenizer file and of the library that runs it: another file or library release misses the cache."""
    from importlib.metadata import version

    lib = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib}|{version(lib)}".encode()).hexdigest()


class Counter:
    """Counts tokens of texts with the tokenizer's own library.

    A byte-level tokenizer without a normalizer never lets a token or a decision of its splitter reach over a place
    where white space follows another character, so a text's count is the sum over the pieces between such places.
    Each worker remembers the counts of at most `remember` pieces and asks the library for the others only.
    Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, remember: int = 400_000):
        self.known: dict[str, int] = {}
        self.remember = remember
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda ts: [len(x) for x in model.encode(ts, num_threads=1)]
            self.by_piece = False
        else:
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._library = lambda ts: [len(x) for k in range(0, len(ts), 512) for x in model.encode_batch_fast(ts[k : k + 512], add_special_tokens=False)]
            with open(path) as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            self.by_piece = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))

    def __call__(self, many: list[str]) -> list[int]:
        if not self.by_piece:
            return self._library(many)
        pieces = [_PIECE.findall(t) for t in many]
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        if len(known) + len(new) > self.remember:
            known.clear()
            new = list({p for ps in pieces for p in ps})
        known.update(zip(new, self._library(new)))
        return [sum(map(known.__getitem__, ps)) for ps in pieces]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def read_cache(spark: SparkSession, cache_dir: str) -> DataFrame:
    """The stored counts; a folder that doesn't exist yet is an empty cache."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache_dir)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; new counts are appended to cache_dir.

    Normalised content: null becomes the empty text, nothing else, since every other change could change a count.
    Rows with one doc_id and different texts keep their own counts; repeated rows repeat; null ids stay.
    Only ids and digests are grouped. One row is picked for each missing digest and encoded. Where few digests are missing, as on a
    corpus that the cache knows, they are broadcast and texts stay where they are read; else each text moves once, to meet what is missing.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    d = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    keyed = stored(d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "token-digests")
    have = read_cache(spark, cache_dir).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = stored(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(have, "digest", "left_anti"), "token-misses")
    misses = F.broadcast(missing) if missing.count() <= FEW_MISSING else missing.hint("shuffle_hash")

    def run(batches):
        count = counter(tokenizer_path)
        for b in batches:
            a = 0
            sizes = [len(x) for x in b.column(1).to_pylist()]
            while a < b.num_rows:
                e, n = a, 0
                while e < b.num_rows and (e == a or n + sizes[e] <= chunk_bytes):
                    n += sizes[e]
                    e += 1
                part = b.slice(a, e - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])
                a = e

    # Ids that several texts share, or null, leave several candidates for a digest; the digest is part of the join.
    picked = misses.alias("m").join(d.withColumn("digest", digest).alias("d"), F.col("m.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("m.digest") == F.col("d.digest")))
    fresh = picked.select(F.col("d.digest"), F.col("d.text")).mapInArrow(run, "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").dropDuplicates(["digest"]).write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    """A new cache folder beside the session's other shared files."""
    import uuid

    return f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
