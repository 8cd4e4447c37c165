"""Language-model scores from a log-frequency Bloom filter.

The filter holds the counts of all training unigrams and bigrams, each quantised to
q = 1 + floor(log(c) / log(BASE)): the n-gram is a member at the levels 0 to q-1. A count is read
back by asking level after level until the first no (Talbot & Osborne, 2007). The model
interpolates

    P(w | h) = k(h) * min(1, low(h, w) / high(h)) + (1 - k(h)) * (low(w) + 1/2) / (N + (V + 1) / 2)

with low and high the ends of a count's bin and k(h) = MOST * c(h) / (c(h) + KAPPA). Taking numerators from the
low ends and denominators from the high ends keeps the sum over words at one or less, false
positives aside. The filter is built in segments by the reducers, each as large as its entries need, and
kept in the shared folder. Passes over the texts broadcast as many segments as a bound allows and add
what they hold of each token's counts, so false positives are as rare in a large corpus as in a small one.

The base score needs exact counts. The most frequent words, a bounded number, are broadcast with
theirs; what a document has of all other words is summed and joined to the full table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bytewords import buffer_of, lower, mix, slices, span_hashes, word_spans
from .common import fold, stored, texts
from .features import row_sums

U64 = np.uint64
BASE, KAPPA, MOST = 1.5, 2.0, 0.25
END, START = U64(0x8F1BBCDCBFA53E0B), U64(0x5A827999CA62C1D6)
#: Bigram hashes gathered before a map task sums them.
GATHER = 2_000_000


def quantise(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def low(q: np.ndarray) -> np.ndarray:
    """The least count of bin q; zero for q = 0."""
    return np.where(q > 0, np.ceil(BASE ** np.maximum(q - 1, 0) - 1e-9), 0.0)


def high(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.ceil(BASE**q - 1e-9) - 1, 0.0)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end after them, what stands before each, and the offsets of the texts."""
    s, e, wo = word_spans(data, off)
    h = span_hashes(lower(data), s, e)
    n = len(off) - 1
    to = wo + np.arange(n + 1)
    t = np.empty(len(h) + n, U64)
    t[to[1:] - 1] = END
    doc = np.repeat(np.arange(n), np.diff(wo))
    t[np.arange(len(h)) + doc] = h
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[to[:-1]] = START
    return t, before, to


def bigram(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xC2B2AE3D27D4EB4F) + mix(t + U64(1)))


def _chunks(column):
    data, off = buffer_of(column)
    for a, b in slices(off, 1 << 19):
        yield a, b, *tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _summed(batches, of):
    return bloom.summed((of(*x[2:]) for b in batches for x in _chunks(b.column(0))), GATHER)


def _with_starts(t, before, to):
    return np.concatenate([t, np.full(len(to) - 1, START)])


class Model:
    """All that a worker needs: one pass's part of the filter, the frequent words with exact counts, N, V and the levels of START."""

    def __init__(self, filter_: bloom.Filter, words: np.ndarray, counts: np.ndarray, n: int, v: int, start: int):
        order = np.argsort(words)
        self.start = start
        self.filter, self.words, self.counts, self.n, self.v = filter_, words[order], counts[order], n, v
        self.all = n + 0.5 * (v + 1)

    def exact(self, t: np.ndarray) -> np.ndarray:
        """Counts of frequent words, -1 for all others."""
        if not len(self.words):
            return np.full(len(t), -1)
        at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
        return np.where(self.words[at] == t, self.counts[at], -1)

    def levels(self, t: np.ndarray, before: np.ndarray, c: np.ndarray) -> np.ndarray:
        """For each token, the levels that this part of the filter holds of it, zero where its count is exact, and of its bigram."""
        q = np.zeros((len(t), 2), np.uint8)
        rare = np.flatnonzero(c < 0)
        q[rare, 0] = self.filter.levels(t[rare])
        q[:, 1] = self.filter.levels(bigram(before, t))
        return q

    def log10(self, q: np.ndarray, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each token. q: levels of all parts together; c: exact counts or -1; starts: where texts begin."""
        q, pair = q[:, 0].astype(np.int64), q[:, 1].astype(np.int64)
        own = np.where(c < 0, low(q), c)
        top = np.where(c < 0, high(q), c)
        h1 = np.empty(len(c))
        h1[1:] = top[:-1]
        h1[starts] = high(np.array([self.start]))[0]
        h2 = low(pair)
        k = MOST * h1 / (h1 + KAPPA)
        return np.log10(k * np.minimum(1.0, h2 / np.maximum(h1, 1)) + (1 - k) * (own + 0.5) / self.all)


def _levels_so_far(b, a, e):
    """Levels that earlier passes found for the tokens of rows a to e, or zero."""
    return buffer_of(b.column(3).slice(a, e - a))[0].reshape(-1, 2) if b.num_columns > 3 else U64(0).astype(np.uint8)


def _level_rows(batches, held):
    """The rows (text, doc_id, held_out, levels) with what one more part of the filter holds."""
    model = held.value
    for b in batches:
        for a, e, t, before, to in _chunks(b.column(0)):
            q = model.levels(t, before, model.exact(t)) + _levels_so_far(b, a, e)
            lists = pa.Array.from_buffers(pa.binary(), e - a, [None, pa.py_buffer((to * 2).astype(np.int32).tobytes()), pa.py_buffer(q.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, e - a) for i in range(3)), lists], ["text", "doc_id", "held_out", "levels"])


def _score_rows(batches, held):
    model = held.value
    part, row = TaskContext.get().partitionId() << 40, 0
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    for b in batches:
        for a, e, t, before, to in _chunks(b.column(0)):
            c = model.exact(t)
            p = model.log10(model.levels(t, before, c) + _levels_so_far(b, a, e), c, to[:-1])
            sure = c >= 0
            base = row_sums(to, np.where(sure, np.log10(np.maximum(c, 0) + 0.5), 0.0))
            doc = np.repeat(np.arange(e - a), np.diff(to))
            off = np.flatnonzero(~sure)
            order = np.lexsort((t[off], doc[off]))
            rd, rh = doc[off][order], t[off][order]
            new = np.flatnonzero(np.concatenate([[True], (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])])) if len(rd) else np.zeros(0, int)
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rd[new], minlength=e - a))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (rh[new].view(np.int64), np.diff(np.append(new, len(rd))))]
            rows = b.slice(a, e - a)
            cols = [np.arange(row, row + e - a) + part, rows.column(1), rows.column(2), np.diff(to), row_sums(to, sure.astype(float)).round().astype(np.int64), base, row_sums(to, p)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols] + lists, schema=schema)
            row += e - a


def portions(segs: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of segments (first, last) of `most` bytes together at most, or of one larger segment."""
    out, size = [], 0
    for s, n in sorted((r["seg"], r["n"]) for r in segs.select("seg", F.octet_length("bits").cast("long").alias("n")).collect()):
        if out and size + n <= most:
            out[-1], size = (out[-1][0], s), size + n
        else:
            out.append((s, s))
            size = n
    return out or [(0, 0)]


def train(docs: DataFrame, *, frequent: int = 1 << 19, max_filter_bytes: int = 512 << 20) -> tuple[list, DataFrame]:
    """(parts, counts): functions that load one broadcastable part of the model each, and the table (h, n) of all training words, from docs (text).

    A part holds max_filter_bytes of the filter at most. Parts are to be loaded in turn; the last one knows what all hold of START.
    """
    text = docs.select("text")
    words = stored(text.mapInArrow(lambda it: _summed(it, lambda t, before, to: t), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # Words at least this frequent number `frequent` at most: from a histogram of at most a few hundred bins.
    bins = sorted(((r["b"], r["c"]) for r in words.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, have = None, 0
    for b, c in bins:
        if have + c > frequent:
            break
        least, have = b, have + c
    top = words.where(F.floor(F.log2("n") * 8) >= least).toPandas() if least is not None else None
    grams = text.mapInArrow(lambda it: _summed(it, lambda t, before, to: np.concatenate([_with_starts(t, before, to), bigram(before, t)])), "h long, n long")
    segs = stored(bloom.segments(grams, bits_per_entry=6, probes=4, quantise=quantise), "lm-filter")
    h = top["h"].to_numpy().view(U64) if top is not None else np.zeros(0, U64)
    n = top["n"].to_numpy().astype(float) if top is not None else np.zeros(0)
    start = [0]

    def load(first, last):
        found = bloom.loaded(segs.where(F.col("seg").between(first, last)), 4)
        start[0] += int(found.levels(np.array([START]))[0])
        return Model(found, h, n, int(total["n"] or 0), int(total["v"]), start[0])

    return [lambda x=x: load(*x) for x in portions(segs, max_filter_bytes)], words


def score(docs: DataFrame, *, held_fold: int = 1, frequent: int = 1 << 19, max_filter_bytes: int = 512 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows in fold held_fold are scored but not learned from. Null and empty texts are one end token. Repeated rows count as often as they
    stand; null ids are learned from and stay. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    d = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", fold() == held_fold)
    loads, words = train(d.where("NOT held_out"), frequent=frequent, max_filter_bytes=max_filter_bytes)
    *first, last = loads
    read = d.select("text", "doc_id", "held_out")
    for part in first:
        held = bloom.share(spark, part())
        read = stored(read.mapInArrow(lambda it, held=held: _level_rows(it, held), "text string, doc_id long, held_out boolean, levels binary"), "lm-levels")
        held.destroy()
    model = last()
    held = bloom.share(spark, model)
    rows = read.mapInArrow(lambda it: _score_rows(it, held), "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<long>")
    rows = stored(rows, "lm-rows")
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    sums = rare.join(words, "h", "left").groupBy("rid").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = rows.drop("rare", "times").join(sums, "rid", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.all))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
