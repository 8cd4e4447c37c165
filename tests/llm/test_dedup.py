"""Near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from scholiast.llm import bloom, decontaminate, embeddings, pfp, simhash, substring_words, suffix_bytes
from scholiast.llm.components import connected_components, roots


def passages(n, seed, joint=" "):
    rnd = random.Random(seed)
    base = [[rnd.choice("ab c d e f".split()) for _ in range(90)] for _ in range(4)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(6)):
            k = rnd.random()
            if k < 0.4:
                w += rnd.choice(base)[rnd.randrange(60) :][: rnd.randrange(1, 80)]
            elif k < 0.6:
                w += ["z"] * rnd.randrange(50)
            else:
                w += [rnd.choice("abcdef") for _ in range(rnd.randrange(30))]
        out.append((i, joint.join(w)))
    return out


def brute_words(rows, size=20):
    first, words = {}, {}
    for d, t in sorted(rows):
        w = words[d] = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (d, i):
                gone[i : i + size] = [True] * size
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_word_passages(spark, odd, empty):
    rows = passages(150, 2)
    got = substring_words.dedup_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(rows)
    r = substring_words.dedup_words(odd).collect()
    long = [(x["doc_id"], x["text"]) for x in odd.where("doc_id = 4").collect()]
    assert len(r) == odd.count() and [x["n_removed"] for x in r if x["doc_id"] == 4] == [brute_words(long)[4][1]]
    assert substring_words.dedup_words(empty).count() == 0


def thue_morse(n, a, b):
    out = [a]
    for _ in range(n):
        out += [b if x == a else a for x in out]
    return "".join(out)


@pytest.mark.parametrize("power", [10, 11])
def test_long_words_are_told_apart(spark, power):
    few = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*few[:9], thue_morse(power, "a", "b"), *few[9:]])), (2, " ".join([*few[:9], thue_morse(power, "b", "a"), *few[9:]]))]
    got = substring_words.dedup_words(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_words(rows) and all(r["n_removed"] == 0 for r in got)


def brute_bytes(rows, size=200):
    c = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if c[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_byte_passages(spark, odd, empty):
    rows = [(i, t.replace("f", "é")) for i, t in passages(120, 3)] + [(1000, "q" * 700), (1001, None)]
    got = suffix_bytes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_bytes(rows)
    assert suffix_bytes.dedup_bytes(odd).count() == odd.count()
    assert suffix_bytes.dedup_bytes(empty).count() == 0


def test_prefix_free_order():
    rnd = random.Random(3)
    for trial in range(40):
        texts = [bytes(rnd.choice(b"ab") if trial % 2 else rnd.randrange(97, 101) for _ in range(rnd.randrange(1, 80))) * rnd.choice([1, 1, 3]) for _ in range(rnd.randrange(1, 12))]
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = pfp.repeated_windows(data, off, 5 + 8 * (trial % 3))
        size = 5 + 8 * (trial % 3)
        seen = Counter(raw[i : i + size] for raw in texts for i in range(len(raw) - size + 1))
        assert got.tolist() == [i + size <= len(raw) and seen[raw[i : i + size]] > 1 for raw in texts for i in range(len(raw))]
        order, text = pfp.corpus_order(data, off, every=3)
        suffixes = [bytes(data[i : off[text[i] + 1]]) for i in order]
        assert suffixes == sorted(suffixes)


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    by = {}
    for r in odd.collect():
        by.setdefault(r["doc_id"], set()).add(f"{brute_fingerprint(r['text']):016x}")
    assert len(got) == odd.count() and all(r["fingerprint"] in by[r["doc_id"]] for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (1, 5, 2, 3)} == {1: 1, 5: 1, 2: 2, 3: 2}
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_pair():
    rnd, masks = random.Random(0), simhash.covering_masks()
    for _ in range(20000):
        x = 0
        for b in rnd.sample(range(64), 4):
            x |= 1 << b
        assert any(x & m == 0 for m in masks)


def groups(n, a, b):
    root = roots(n, np.asarray(a), np.asarray(b))
    out = {}
    for i, r in enumerate(root):
        out.setdefault(r, set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def test_dense_buckets(spark):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 2, dtype=np.int64).view(np.uint64)
    x = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (900, 3)).astype(np.uint64), axis=1) for c in centre] + [rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)]))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    at = {int(v): i for i, v in enumerate(x.view(np.int64))}
    got = {}
    for r in connected_components(links).collect():
        got.setdefault(r["root"], set()).add(at[r["node"]])
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert {frozenset(g) for g in got.values()} == groups(len(x), a, b)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    got = connected_components(links.repartition(7)).collect()
    assert sorted(r["node"] for r in got) == list(range(201)) and {r["root"] for r in got} == {0}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(6, 16))
    x = (c[rng.integers(0, 6, 500)] + rng.normal(size=(500, 16)) * rng.choice([0.02, 0.05, 0.5], (500, 1))).astype(np.float32)
    x[450:] = x[:50]
    rows = [(i, [float(y) for y in v], i % 2) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=40).collect()}
    u = embeddings.unit(x.astype(float))
    near = (u @ u.T >= 0.98) & (np.arange(500)[:, None] % 2 == np.arange(500) % 2)
    np.fill_diagonal(near, False)
    n = near.sum(1)
    found = np.array([got[i]["n_links"] for i in range(500)])
    assert (found <= n).all() and found.sum() >= 0.999 * n.sum()


def test_odd_vectors(spark):
    v = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0], 1), (9, [], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted([("1", 3, 1, True)] * 2 + [("2", 3, 1, False), ("None", 3, 1, False)] + [(str(i), 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)])
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_filters_have_no_false_negatives():
    import pyarrow as pa

    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    q = 1 + (h % np.uint64(4)).astype(np.int16)
    seg = (h & np.uint64(bloom.SEGMENTS - 1)).astype(int)
    names = np.unique(seg)
    f = bloom.Filter(names, pa.array([bloom.pack(h[seg == s], q[seg == s], 8, 3, 1 << 20) for s in names], pa.binary()), 3)
    assert (f.levels(h) >= q).all() and f.contains(h + np.uint64(1)).mean() < 0.2


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, odd, empty, limit):
    import duckdb

    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("lorem ipsum dolor sit amet elit".split()) for _ in range(n))) for i, n in enumerate((20, 13, 9, 3, 1, 0))] + [(7, None), (8, "Été über 5x")]
    rows = [(i, " ".join(rnd.choice(["x", "y", "Été über 5x", items[rnd.randrange(4)][1], items[0][1][: rnd.randrange(80)]]) for _ in range(rnd.randrange(6)))) for i in range(80)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    df = decontaminate.decontaminate(docs, bench, broadcast_rows=limit)
    cols = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {cols} FROM ({decontaminate.ORACLE})").fetchall())
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.decontaminate(odd, empty.withColumnRenamed("doc_id", "item_id")).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


@pytest.mark.parametrize("n", [0, 500, 10**6, 10**8, 10**11])
def test_tables_keep_the_chance_to_miss(n):
    tables, bits = embeddings.shape(n, 0.98)
    assert 12 <= bits <= 30 and n / 2**bits < 128
    assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-4


def test_embeddings_of_more_planes(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SPREAD", 1 / 1000)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 24)), 5, axis=0) + rng.normal(size=(300, 24)) * 0.05
    got = embeddings.near_duplicates(spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    u = embeddings.unit(x)
    assert embeddings.shape(300, 0.98)[1] > 18
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.999 * ((u @ u.T >= 0.98).sum() - 300) > 1000


@pytest.mark.parametrize("query", ["op6_substring_words", "op7_embeddings", "op8_decontaminate", "op9_suffix_bytes"])
def test_queries_equal_their_sql(spark, query):
    import duckdb

    from scholiast.llm import queries

    home = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{home}/{name}.parquet'")
    want = con.sql(queries.ORACLES[query])
    got = queries.QUERIES[query](spark, home)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in want.columns) for r in got.collect())
