"""Tokenizers, counts, classifiers and language model."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from scholiast.llm import bpe, features, lm_filter, quality_fm, queries, token_counts, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    alphabet = [*"ab 'srelv\n\t1é \x1c !漢😀\x85᠎", "<|endoftext|>", "  ", " \n", " "]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_tree_encoding_is_the_librarys(library):
    c = bpe.TreeBPE(RANKS, P.PATTERN, leaf=8, span=2)
    for t in [*odd_texts(2000), "a" * 3000, " " * 500, "x y " * 900]:
        ids = c.encode(t)
        assert ids == library(t)
        assert c.decode(ids, leaf=3) == t.encode()


def test_round_trip_rows(odd, empty, library):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect()}
    for r in odd.collect():
        t = r["text"] or ""
        x = got[r["doc_id"], len(library(t))]
        assert x["exact"] and x["ids_sha256"] == hashlib.sha256(" ".join(map(str, library(t))).encode()).hexdigest()
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    ids = bpe.encode_documents(odd, RANKS, P.PATTERN)
    assert sorted(bytes(r["content"]).decode() for r in bpe.decode_ids(ids, RANKS, P.PATTERN).collect()) == sorted((r["text"] or "") for r in odd.collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    count = token_counts.Counter(P.path(name), remember=50)
    ts = odd_texts(400, 3)
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(ts)]
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        t.no_truncation()
        want = [len(t.encode(x, add_special_tokens=False)) for x in ts]
    assert count(ts) == want


def test_count_cache(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t, cache = Tokenizer.from_file(P.path("byte_bpe_50k.json")), str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all counts stored
        got = token_counts.count_tokens(odd, P.path("byte_bpe_50k.json"), cache).collect()
        want = sorted((str(r["doc_id"]), len(t.encode(r["text"] or "", add_special_tokens=False))) for r in odd.collect())
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    assert token_counts.read_cache(spark, cache).count() == len({r["text"] or "" for r in odd.collect()})
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json"), cache).count() == 0


def planted(n, seed, share=0.15):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(20, 80))]
        bad = rnd.random() < share
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["vile", "vileness"])
            w[rnd.randrange(len(w))] = "nasty"
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_positive_unlabelled(spark):
    rows = planted(1500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    rnd = random.Random(0)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if rnd.random() < 0.6], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert held_out_auc(held) > 0.9


def held_out_auc(pairs):
    order = sorted(pairs)
    ranks = [k for k, (_, y) in enumerate(order) if y]
    n1, n0 = len(ranks), len(order) - len(ranks)
    return (sum(ranks) - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("query, label, least", [("op1_toxicity", "toxic", 0.95), ("op5_quality", "quality", 0.95)])
def test_classifiers_on_held_out_rows_of_the_real_table(spark, query, label, least):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where(f"{label} IS NOT NULL").select("doc_id", label)
    scored = queries.QUERIES[query](spark, d)
    assert held_out_auc([(r[0], r[1]) for r in scored.where("held_out").join(labels, "doc_id").select("score", label).collect()]) >= least


def test_toxicity_of_odd_tables(spark, odd, empty):
    rows = planted(600, 5)
    docs = spark.createDataFrame([(i, t, 1.0, "clash") for i, t, _ in rows], "doc_id long, text string, score double, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 5, None)}) <= 2  # equal texts, equal scores; null and empty texts too
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    calm = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert calm.where("predicted = 1").count() == 0


def test_risk_is_clamped():
    """With everything labelled toxic but a prior near zero, the clean part would go negative; scores must stay finite."""
    ptr, idx, st = features.featurize(pa.array(["a b", "a c", "d e", "f"] * 8), 10)
    m = toxicity.NonNegativePU(bits=10).fit(ptr, idx, st, np.array([True, True, False, False] * 8), 0.01)
    assert np.isfinite(m(ptr, idx, st)).all()


def test_factorisation_identity():
    ptr, idx, st = features.featurize(pa.array(["a b c", "d", ""]), 6)
    m = quality_fm.FactorisationMachine(bits=6)
    m.v = np.random.default_rng(0).normal(size=m.v.shape)
    own, f, x = m.inputs(ptr, idx, st)
    z, _, _ = m.forward(own, f, x)
    for r in range(3):
        ff, xx = f[own[r] : own[r + 1]], x[own[r] : own[r + 1]]
        pairs = sum(m.v[ff[i]] @ m.v[ff[j]] * xx[i] * xx[j] for i in range(len(ff)) for j in range(i + 1, len(ff)))
        assert z[r] == pytest.approx(pairs, abs=1e-9)


def test_quality(spark, odd, empty):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(60)) + "." for _ in range(400)]
    junk = [" | ".join(rnd.choice(["alpha", "beta"]) for _ in range(60)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(500)], "doc_id long, quality int")
    model = quality_fm.train(docs, labels)
    got = quality_fm.score(docs, model).where("held_out").collect()
    assert all(r["predicted"] == (r["doc_id"] < 400) for r in got)
    assert quality_fm.score(odd, model).count() == odd.count()
    assert quality_fm.score(empty, quality_fm.train(empty, labels)).count() == 0
    assert quality_fm.filter_documents(docs, model).count() == quality_fm.score(docs, model).where("predicted = 1").count()


def test_language_model(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(odd_texts(60, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    toks = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for (i, _), t in zip(rows, toks) if fold(i) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (i, _), t in zip(rows, toks))
    for frequent in (1 << 19, 4):  # all counts broadcast, or nearly all joined
        got = lm_filter.score(docs, frequent=frequent).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and r["train_tokens"] == n for r in got)
    assert lm_filter.score(empty).count() == 0


def test_quantised_counts():
    n = np.arange(1, 5000)
    q = lm_filter.quantise(n)
    assert (lm_filter.low(q) <= n).all() and (lm_filter.high(q) >= n).all()
