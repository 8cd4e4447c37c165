"""Sparse features of texts for the classifiers: hashed distinct words and a few numbers on structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASE, buffer_of, lower, slices, span_hashes, word_spans
from .common import fold, texts

U64 = np.uint64
#: Names of the structure statistics, in the order of their columns.
STATS = ("log_bytes", "log_words", "word_length", "distinct_share", "top_run_share", "letters", "upper", "digits", "spaces", "newlines", "symbols", "pipes", "high_bytes", "words_with_symbols", "short_words", "line_length")
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_CLASS = np.full(256, 6, np.int64)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line feed, 5 pipe, 6 symbol, 7 not ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 13, 11, 12]], _CLASS[10], _CLASS[124], _CLASS[128:] = 0, 1, 2, 3, 4, 5, 7


def featurize(column: pa.Array, bits: int, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of an Arrow column: hashed distinct words as (offsets, indices), and the STATS matrix.

    Words are lower-cased runs between white space, without ASCII marks at their end; with prefixes, the first so many bytes of each
    longer word are features as well. Null and empty texts have no words and zero statistics.
    """
    data, off = buffer_of(column)
    counts, index, stats = [], [], []
    for a, b in slices(off):
        x, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        n = b - a
        s, e, wo = word_spans(x, o)
        y = lower(x)
        core = e.copy()
        for _ in range(3):
            core -= (core - 1 > s) & _MARK[x[core - 1]]
        h = span_hashes(y, s, core)
        words = np.diff(wo)
        doc = np.repeat(np.arange(n), words)
        key = (doc.astype(U64) << U64(40)) | (h >> U64(24))  # 40 bits tell the words of one text apart
        key, first = np.unique(key, return_index=True)
        of = doc[first]
        distinct = np.bincount(of, minlength=n)
        for length in prefixes:
            more = first[core[first] - s[first] > length]
            part = (doc[more].astype(U64) << U64(40)) | (span_hashes(y, s[more], s[more] + length, BASE + 2 * length) >> U64(24))
            key = np.concatenate([key, np.unique(part)])
        if prefixes:
            key.sort()
        index.append(((key & U64((1 << 40) - 1)) >> U64(40 - bits)).astype(np.int32))
        counts.append(np.bincount((key >> U64(40)).astype(np.int64), minlength=n))

        size = np.diff(o)
        which = np.repeat(np.arange(n), size)
        kinds = np.bincount(which * 8 + _CLASS[x], minlength=8 * n).reshape(n, 8).astype(float)
        part = kinds / np.maximum(size, 1)[:, None]
        length = (e - s).astype(float)
        nw = np.maximum(words, 1)
        mean = lambda v: np.bincount(doc, v, minlength=n) / nw
        last = x[e - 1] if len(e) else x
        odd = np.isin(last, np.frombuffer(b"$%&*#|=+~^<>{}[]@", np.uint8))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        stats.append(
            np.column_stack(
                [np.log1p(size) / 10, np.log1p(words) / 8, mean(length) / 10, distinct / nw, mean(same.astype(float)), part[:, 0], part[:, 1] * 5, part[:, 2] * 5, part[:, 3] * 3, part[:, 4] * 20]
                + [part[:, 6] * 5, part[:, 5] * 10, part[:, 7] * 2, mean(odd.astype(float)), mean((length <= 2).astype(float)), np.log1p(size / (1 + kinds[:, 4])) / 8]
            )
        )
    if not counts:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros((0, len(STATS)))
    st = np.concatenate(stats)
    st[np.diff(off) == 0] = 0
    return np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(index), st


def pick(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n rows whose ids come first by hash: a bounded sample that doesn't depend on the layout of the files."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def sample_features(docs: DataFrame, chosen: DataFrame, bits: int, prefixes: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the chosen rows (doc_id, y), brought to the driver; the callers bound how many are chosen.

    Rows come ordered by id hash, so training sees the same order whatever the partitions.
    """

    def run(batches):
        for b in batches:
            ptr, idx, st = featurize(b.column(1), bits, prefixes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(idx)), pa.ListArray.from_arrays(pa.array(np.arange(len(st) + 1, dtype=np.int32) * len(STATS)), pa.array(st.ravel()))],
                ["doc_id", "y", "idx", "st"],
            )

    d = texts(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    got = d.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, idx array<int>, st array<double>")
    t = got.orderBy(F.xxhash64("doc_id"), "doc_id", "y").toArrow()
    if not len(t):
        return np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros((0, len(STATS))), np.zeros(0, int)
    parts = lambda name: t[name].chunks
    lens = np.concatenate([x.value_lengths().to_numpy() for x in parts("idx")]).astype(np.int64)
    flat = lambda name: np.concatenate([x.flatten().to_numpy() for x in parts(name)])
    return np.concatenate([[0], np.cumsum(lens)]), flat("idx"), flat("st").reshape(-1, len(STATS)), t["y"].to_numpy().astype(int)


def with_scores(docs: DataFrame, score, threshold: float, bits: int, prefixes: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. score maps (offsets, indices, stats) to probabilities; its weights have a fixed size and are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(score)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                p = held.value(*featurize(part.column(1), bits, prefixes))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    d = texts(docs, id_col, text_col)
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def row_sums(ptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values within each row; values may have a second axis."""
    ends = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=ends[1:])
    return ends[ptr[1:]] - ends[ptr[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
