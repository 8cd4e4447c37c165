"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Links stay in tables. A node with very many links is never gathered: minima come from grouped
aggregation with map-side combination, and are joined back to the links, where adaptive execution
may split a skewed node. Each round is written to the shared folder, so lineage stays short and a
lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For links a-b among 0..n-1, the smallest node of each node's component: hooking and pointer jumping in numpy."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) replaced, partition by partition and batch by batch, by a star for each of their components: fewer links, the same components."""

    def run(batches):
        for x in batches:
            a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = roots(len(ids), at[: len(a)], at[len(a) :])
            own = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node in links (a, b longs), the smallest node it is connected with, itself included.

    Null ends and loops link nothing; a node that only has those is not in the result. An empty table gives an empty one.
    """
    proper = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stored(contract(proper).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
