"""Owners that are too large for one task are dealt again by window, with the same results."""

import random

import numpy as np
import pyarrow as pa

from scholiast.llm import substring_words, suffix_bytes

from .test_dedup import brute_bytes, brute_words, passages


def test_groups_stop_growing():
    v = [1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i : i + 3], pa.int64()), pa.array(np.arange(3))], ["k", "x"]) for i in range(0, 12, 3)]
    got = [(t.column(0).to_pylist(), whole) for t, whole in substring_words.whole_groups(iter(batches), most=60)]
    assert [x for t, _ in got for x in t] == v and {x for t, whole in got for x in t if not whole} == {2} and max(len(t) for t, _ in got) <= 3


def footers(n=160):
    rnd = random.Random(4)
    line = "All rights reserved. This text may be copied with its notice, as the licence of its owner has it, or not at all, so there. " * 1
    return [(i, "".join(rnd.choice("abcdefgh ") for _ in range(90)) + line + rnd.choice(["one and the same end of many a text " * 4, "".join(rnd.choice("abcdefgh ") for _ in range(90))])) for i in range(n)]


def test_hot_owners_of_bytes(spark):
    rows = [(1000 + i, t) for i, t in passages(60, 3)] + footers()
    got = suffix_bytes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True, most=1).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(rows)


def test_hot_owners_of_words(spark):
    rows = [(1000 + i, t) for i, t in passages(80, 2)] + footers()
    got = substring_words.dedup_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True, most=1).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(rows)
