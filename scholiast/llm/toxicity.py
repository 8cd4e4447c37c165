"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label; all other text is unlabelled and holds toxic texts at a
rate pi, the class prior. With losses l(+) and l(-), the risk of a classifier is

    pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)])

The second term estimates the risk on the clean part of the unlabelled text. It can't be negative
in truth; when a mini-batch's estimate falls below zero, the step instead climbs that term, so that
a flexible classifier can't drive the risk below zero by memorising the positives (Kiryo et al., 2017).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts
from .features import STATS, pick, row_sums, sample_features, sigmoid, with_scores


PREFIXES = (4, 5)


class NonNegativePU:
    """Linear classifier over hashed distinct words and structure statistics, trained by Adagrad on the non-negative risk with logistic loss.

    The logit is the sum of the weights of a text's distinct words and word beginnings, so that one strong word counts alike in short and long texts.
    Only features whose share of positive texts differs from that of unlabelled ones by `screen` standard errors get a weight; of the many
    thousand others, each would add its noise to the sum. Where no feature differs, the statistics alone decide.
    """

    def __init__(self, bits: int = 18, epochs: int = 60, batch: int = 4096, positives: int = 1024, rate: float = 0.3, decay: float = 2e-5, screen: float = 5.0, seed: int = 7):
        self.bits, self.epochs, self.batch, self.positives, self.rate, self.decay, self.screen, self.seed = bits, epochs, batch, positives, rate, decay, screen, seed
        self.w, self.v, self.b = np.zeros(1 << bits), np.zeros(len(STATS)), 0.0

    def logit(self, ptr, idx, st) -> np.ndarray:
        return row_sums(ptr, self.w[idx]) + st @ self.v + self.b

    def __call__(self, ptr, idx, st) -> np.ndarray:
        return sigmoid(self.logit(ptr, idx, st))

    def telling(self, ptr, idx, positive: np.ndarray) -> np.ndarray:
        """A mask of the features whose rates in positive and in other rows differ by `screen` standard errors or more."""
        of = np.repeat(positive, np.diff(ptr))
        n, m = positive.sum(), (~positive).sum()
        a, b = (np.bincount(idx[k], minlength=len(self.w)) for k in (of, ~of))
        mean = np.clip((a + b) / (n + m), 0, 1)
        return np.abs(a / n - b / m) >= self.screen * np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n + 1 / m))

    def fit(self, ptr, idx, st, positive: np.ndarray, prior: float) -> NonNegativePU:
        """positive marks confirmed toxic rows; all others are drawn from all text, toxic at rate prior. Without positives every score stays at the prior."""
        prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
        self.b = np.log(prior / (1 - prior))
        pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
        if not len(pos) or not len(unl):
            return self
        told = self.telling(ptr, idx, positive)[idx]
        ptr, idx = np.concatenate([[0], np.cumsum(told)])[ptr], idx[told]
        rng = np.random.default_rng(self.seed)
        gw, gv, gb = np.full(1 << self.bits, 1e-3), np.full(len(STATS), 1e-3), 1e-3
        steps = -(-len(unl) // self.batch)
        for _ in range(self.epochs):
            order = rng.permutation(unl)
            for k in range(steps):
                u, p = order[k::steps], rng.permutation(pos)[: self.positives]
                rows = np.concatenate([p, u])
                lens = ptr[rows + 1] - ptr[rows]
                own = np.concatenate([[0], np.cumsum(lens)])
                ii = idx[np.arange(own[-1]) - np.repeat(own[:-1] - ptr[rows], lens)]
                z = self.logit(own, ii, st[rows])
                s = sigmoid(z)
                zp, sp, zu, su = z[: len(p)], s[: len(p)], z[len(p) :], s[len(p) :]
                rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                g = np.zeros(len(rows))
                if rest >= 0:
                    g[: len(p)] = prior * (sp - 1) / len(p) - prior * sp / len(p)
                    g[len(p) :] = su / len(u)
                else:
                    g[: len(p)] = prior * sp / len(p)
                    g[len(p) :] = -su / len(u)
                dw = np.bincount(ii, np.repeat(g, lens), minlength=len(self.w))
                hit = np.flatnonzero(dw)
                d = dw[hit] + self.decay * self.w[hit]
                gw[hit] += d * d
                self.w[hit] -= self.rate * d / np.sqrt(gw[hit])
                dv = g @ st[rows]
                gv += dv * dv
                self.v -= 0.04 * self.rate * dv / np.sqrt(gv)
                db = g.sum()
                gb += db * db
                self.b -= self.rate * db / np.sqrt(gb)
        return self


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = 8000, max_unlabelled: int = 16000, label: str = "toxic", unknown: float = 0.01, **params) -> NonNegativePU:
    """A classifier from at most max_positive confirmed toxic texts and max_unlabelled others, both outside the held-out fold.

    The unlabelled rows are drawn from all training documents, confirmed ones included (such a text stands on both sides), so that toxic
    texts have the same rate among them as in the corpus, whatever part is labelled. That rate, the prior, is the labelled toxic rate of
    the training fold; rows with a null label or id are not used. Without any label the score of every text is `unknown`, so nothing is
    called toxic. Ties and repeated rows weigh as often as they stand; other columns are not read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rate = known.agg(F.avg("y").alias("r")).first()["r"]
    model = NonNegativePU(**params)
    if rate is None:
        model.b = float(np.log(unknown / (1 - unknown)))
        return model
    ids = texts(docs).select("doc_id").where(F.col("doc_id").isNotNull() & (fold() != 0)).distinct()
    positives = pick(known.where("y = 1"), max_positive).select("doc_id", F.lit(1).alias("y"))
    drawn = pick(ids, max_unlabelled).select("doc_id", F.lit(0).alias("y"))
    ptr, idx, st, y = sample_features(docs, positives.unionByName(drawn), model.bits, PREFIXES)
    return model.fit(ptr, idx, st, y == 1, float(rate))


def score(docs: DataFrame, model: NonNegativePU, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the score of a text without words."""
    return with_scores(docs, model, threshold, model.bits, PREFIXES, id_col, text_col)
