"""The pipeline's near-dedup against brute force over all pairs."""

import random

import corpus_pipeline as C
from scholiast.llm import near_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, size=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(texts, least=(4, 5)):
    """Index of the first text of each text's group, by all pairs of similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or least[1] * len(a & sets[j]) >= least[0] * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return [root(i) for i in range(len(texts))]


def copies(seed=1, n=25):
    """Texts with copies of similarity around 0.8 to 0.95 and a line that all share; the similarities of the planted pairs."""
    rnd = random.Random(seed)
    line = [f"line{i}" for i in range(30)]
    out = []
    for g in range(n):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((30, 120, 260)))] + line
        out.append(" ".join(w))
        for _ in range(4):
            c = list(w)
            for _ in range(max(1, round(len(w) * rnd.choice((0.006, 0.012, 0.02, 0.024))))):
                c[rnd.randrange(len(c))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(c))
    return out


def same_groups(spark, texts):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, rk long, text string").repartition(3)
    got = {r["rk"]: r["component"] for r in near_sets.near_duplicates(docs).collect()}
    first = {}
    assert [first.setdefault(got[i], i) for i in range(len(texts))] == brute_groups(texts)


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    texts = [*copies(), None, "", "one two", "one two", "a b c d e", "A B c d e"]
    sets = [shingles(t) for t in texts]
    planted = [len(a & b) / len(a | b) for a, b in ((sets[g], sets[g + k]) for g in range(0, 125, 5) for k in range(1, 5))]
    assert sum(0.8 <= x < 0.95 for x in planted) >= 40 and any(x < 0.8 for x in planted)
    same_groups(spark, texts)


def test_large_buckets():
    """All pairs of one bucket that pass the bounds, block by block, with none of similarity 0.8 missed."""
    import numpy as np
    import pyarrow as pa

    texts = copies(3, 130)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sh, off = near_sets.shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 5)
    n, s = np.diff(off), near_sets.digests(sh, off).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(off)) * near_sets.SKETCH).astype(np.int32)), pa.array(near_sets.sketches(sh, off).reshape(-1).view(np.int64)))
    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int64)), pa.array(s), pa.array(n), pa.array(s), lists], ["h", "s", "n", "label", "sketch"])
    assert len(n) > near_sets.BLOCK
    found = {(x, y) for p in near_sets._all_pairs([b.slice(0, 300), b.slice(300)], 4, 5) for x, y in zip(p.column(0).to_pylist(), p.column(1).to_pylist())}
    sets = [set(sh[off[i] : off[i + 1]].tolist()) for i in range(len(n))]
    want = {tuple(sorted((int(s[i]), int(s[j])))) for i in range(len(n)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert want and want <= found and len(found) < len(n) ** 2 / 8


def test_edited_copies_go(spark):
    texts = copies(5, 12)
    docs = spark.createDataFrame([(100 - i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    root, last = brute_groups(texts), {}
    for i, r in enumerate(root):
        last[r] = 100 - i
    assert sorted(r["doc_id"] for r in C.near_dedup(spark, docs, None).collect()) == sorted(last.values())


def test_texts_that_share_a_frequent_passage_do_not_meet(spark):
    """Long texts with one passage of a quarter of each: the order by frequency leaves no pair of them to compare, and near copies are still found."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([*(f"w{rnd.randrange(10**6)}" for _ in range(240)), *passage]) for _ in range(200)]
    texts += [t.replace(" p3 ", " q3 ", 1) for t in texts[:3]]
    made, stored = [], near_sets.stored

    def counting(df, name):
        out = stored(df, name)
        if name == "near-met":
            made.append(out.groupBy("h").count().where("count > 4").count())
        return out

    near_sets.stored = counting
    try:
        same_groups(spark, texts)
    finally:
        near_sets.stored = stored
    assert made == [0]


def beginnings(n=40):
    """Pairs of a text and its first part with exactly 0.8 of the shingles, in every fourth pair with one less."""
    rnd = random.Random(11)
    out = []
    for g in range(n):
        w = [f"b{g}x{rnd.randrange(10**6)}" for _ in range(104 + 100 * (g % 2))]
        out += [" ".join(w), " ".join(w[: (len(w) - 4) * 4 // 5 + 4 - (g % 4 == 3)])]
    return out


def made_pairs(texts):
    """Rows that the last round makes of texts that nothing has linked yet, in one order of shingles by hash; and sets and digests."""
    import numpy as np
    import pyarrow as pa

    class Any:
        levels = staticmethod(lambda h: np.zeros(len(h), np.int64))
        contains = staticmethod(lambda h: np.ones(len(h), bool))

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sh, off = near_sets.shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 5)
    pre, edges = near_sets._prefixes(sh, off, 4, 5, Any)
    s = near_sets.digests(sh, off).view(np.int64)
    sketch = near_sets._lists(near_sets.sketches(sh, off).reshape(-1), np.arange(len(off)) * near_sets.SKETCH)
    b = pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.diff(off)), near_sets._lists(pre, edges), sketch], ["s", "n", "prefix", "sketch"])
    t = pa.Table.from_batches(list(near_sets._met_rows([b.slice(0, 7), b.slice(7)], Any))).sort_by("h")
    t = t.add_column(3, "label", t["s"])
    made = [p for x in near_sets._all_pairs(t.to_batches(max_chunksize=500), 4, 5) for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    return made, [set(sh[off[i] : off[i + 1]].tolist()) for i in range(len(s))], s.tolist()


def test_a_pair_is_made_where_its_first_common_shingle_stands():
    """Families of texts just below 0.8, and links among them: no link is missed, and a pair isn't made again in the bucket of each shingle that it shares."""
    rnd = random.Random(13)
    texts = [*copies(17, 12), *beginnings()]
    for g in range(4):
        w = [f"f{g}x{i}" for i in range(400)]
        for _ in range(30):
            c = list(w)
            for _ in range(14):
                c[rnd.randrange(400)] = f"y{rnd.randrange(10**6)}"
            texts.append(" ".join(c))
    made, sets, s = made_pairs(texts)
    want = {tuple(sorted((s[i], s[j]))) for i in range(len(s)) for j in range(i) if s[i] != s[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 60 and want <= set(made)
    assert len(made) < 8 * len(set(made)), (len(made), len(set(made)))


def test_texts_and_their_beginnings(spark):
    """A link at exactly 0.8 has all of the smaller set in the larger: its first common shingle is the smaller's first."""
    same_groups(spark, beginnings())
