"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The bracket is the sum-of-squares identity: all pairwise interactions in time linear in the
features of a text. Inputs are the hashed distinct words, each with value 1/sqrt(their number);
the structure statistics, each cut into bins of which one is set; and the metadata that the text
itself gives, its size in bytes and in lines, binned likewise. Labels, language, source and id are
no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold
from .features import STATS, featurize, pick, row_sums, sample_features, sigmoid, with_scores

BINS = 16


class FactorisationMachine:
    """Logistic factorisation machine trained by Adagrad in numpy. Every array has a fixed size: 2**bits words plus BINS per statistic."""

    def __init__(self, bits: int = 16, factors: int = 8, epochs: int = 8, batch: int = 512, rate: float = 0.1, decay: float = 1e-4, seed: int = 11):
        self.bits, self.factors, self.epochs, self.batch, self.rate, self.decay, self.seed = bits, factors, epochs, batch, rate, decay, seed
        self.size = (1 << bits) + BINS * len(STATS)
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (self.size, factors))
        self.edges = np.zeros((BINS - 1, len(STATS)))

    def inputs(self, ptr, idx, st):
        """Rows of (feature, value) with the bins of the statistics appended to the words of each row."""
        n, k = len(st), len(STATS)
        words = np.diff(ptr)
        own = np.concatenate([[0], np.cumsum(words + k)])
        feature, value = np.empty(own[-1], np.int64), np.empty(own[-1])
        at = np.arange(ptr[-1]) + np.repeat(np.arange(n) * k, words)
        feature[at], value[at] = idx, np.repeat(1 / np.sqrt(np.maximum(words, 1)), words)
        bins = np.stack([np.searchsorted(self.edges[:, j], st[:, j], "right") for j in range(k)], 1) if n else np.zeros((0, k), np.int64)
        at = (own[1:, None] - k + np.arange(k)).ravel()
        feature[at], value[at] = ((1 << self.bits) + np.arange(k) * BINS + bins).ravel(), 0.25
        return own, feature, value

    def forward(self, own, feature, value):
        vx = self.v[feature] * value[:, None]
        sums = row_sums(own, vx)
        z = self.w0 + row_sums(own, self.w[feature] * value) + 0.5 * ((sums * sums).sum(1) - row_sums(own, (vx * vx).sum(1)))
        return z, vx, sums

    def __call__(self, ptr, idx, st) -> np.ndarray:
        return sigmoid(self.forward(*self.inputs(ptr, idx, st))[0])

    def fit(self, ptr, idx, st, y: np.ndarray) -> FactorisationMachine:
        """Fits the logistic loss. With one class or no rows, every score is the smoothed rate of label 1."""
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if len(y) == 0 or y.min() == y.max():
            self.v[:] = 0
            return self
        self.edges = np.quantile(st, np.arange(1, BINS) / BINS, axis=0)
        own, feature, value = self.inputs(ptr, idx, st)
        rng = np.random.default_rng(self.seed)
        g0, gw, gv = 1e-2, np.full(self.size, 1e-2), np.full(self.v.shape, 1e-2)
        batch = min(self.batch, max(16, len(y) // 24))
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                lens = own[rows + 1] - own[rows]
                o = np.concatenate([[0], np.cumsum(lens)])
                take = np.arange(o[-1]) - np.repeat(o[:-1] - own[rows], lens)
                f, x = feature[take], value[take]
                z, vx, sums = self.forward(o, f, x)
                g = (sigmoid(z) - y[rows]) / len(rows)
                gx = np.repeat(g, lens) * x
                each = gx[:, None] * (np.repeat(sums, lens, 0) - vx)
                hit, at = np.unique(f, return_inverse=True)
                dw = np.bincount(at, gx, minlength=len(hit)) + self.decay / len(rows) * self.w[hit]
                dv = np.stack([np.bincount(at, each[:, j], minlength=len(hit)) for j in range(self.factors)], 1) + self.decay / len(rows) * self.v[hit]
                g0 += g.sum() ** 2
                self.w0 -= self.rate * g.sum() / np.sqrt(g0)
                gw[hit] += dw * dw
                self.w[hit] -= self.rate * 5 * dw / np.sqrt(gw[hit])
                gv[hit] += dv * dv
                self.v[hit] -= self.rate * dv / np.sqrt(gv[hit])
        return self


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 16000, label: str = "quality", **params) -> FactorisationMachine:
    """A machine from at most max_rows labelled texts outside the held-out fold, chosen by id hash, half of them of each label where there are enough.

    Scores are thus those of balanced classes, whatever the labelled rate. Rows with a null label or id are not used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    model = FactorisationMachine(**params)
    chosen = pick(known.where("y = 0"), max_rows // 2).unionByName(pick(known.where("y = 1"), max_rows // 2))
    ptr, idx, st, y = sample_features(docs, chosen, model.bits)
    few = int(min((y == 0).sum(), (y == 1).sum()))
    if 0 < few < len(y) // 3:  # the scarcer label counts as often as the other
        rare = np.flatnonzero(y == int((y == 1).sum() == few))
        rows = np.concatenate([np.arange(len(y)), np.resize(rare, len(y) - 2 * few)])
        lens = np.diff(ptr)[rows]
        own = np.concatenate([[0], np.cumsum(lens)])
        ptr, idx, st, y = own, idx[np.arange(own[-1]) - np.repeat(own[:-1] - ptr[rows], lens)], st[rows], y[rows]
    return model.fit(ptr, idx, st, y)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the score of a text without words."""
    return with_scores(docs, model, threshold, model.bits, (), id_col, text_col)


def filter_documents(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `threshold` or more: a map, nothing is moved."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                yield part.filter(pa.array(held.value(*featurize(part.column(at), held.value.bits)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
