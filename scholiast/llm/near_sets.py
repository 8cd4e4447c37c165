"""Near-duplicates by SimHash with exact Jaccard similarity of word shingles, and a prefix-filtered self-join for what SimHash misses.

Covering LSH over the SimHash fingerprints (module simhash) proposes pairs first; those whose shingle sets have a similarity of
0.8 or more are links. Texts of similarity 0.8 differ in some ten bits of 64, far outside any radius that masks can cover, so pairs that
are still apart are searched by their shingles. Two sets of similarity 0.8 or more overlap so far that, under any common order of shingles, they share
one of the first n - ceil(0.8 n) + 1 elements of each (Bayardo et al., 2007). Sets meet by those
alone, so no such pair is missed, whatever the data. The order is by how often shingles stand in a sample of distinct texts, rarest
first, so that sets meet by what few texts share; it only saves work. Of what meets, sizes and a parity sketch give exact bounds
(the sketches differ in no more bits than the sets in elements). A pair is made where its first common element stands: what comes after that in
either set bounds their overlap (Xiao et al., 2008), and a pair that also shares the element before is left to that one's bucket. What passes is compared shingle by
shingle. Pairs that are already connected need no comparison: SimHash and rounds of few neighbours link large
groups first, and the last round compares every pair that is still apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bytewords import WORD_BASE, buffer_of, lower, mix, range_hashes, runs, slices, span_hashes, spread, sums_of, word_spans
from .common import parts, stored
from .components import connected_components
from .simhash import fingerprint, near_links

U64 = np.uint64
#: Words of the sketches in buckets, 64 bits each. Wide sketches, held against each other before sets are fetched, have two bits an element.
SKETCH = 4
#: Later sets of a bucket that the linking rounds look at, and how many of them each set is compared with.
LOOK, TAKE = 16, 2
#: One distinct text in SAMPLE is counted; shingles met twice or more in it are ordered by the logarithm of their count, kept in a filter of FREQUENT bytes at most.
SAMPLE, FREQUENT = 8, 64 << 20
#: Sets whose pairs are looked at together.
BLOCK = 512


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, end to end, and the n+1 offsets. A shorter text is one shingle, a wordless one has none."""
    s, e, wo = word_spans(data, off)
    h = span_hashes(lower(data), s, e)
    n = np.diff(wo)
    m = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), m)
    start = wo[:-1][doc] + spread(m)
    sh = range_hashes(sums_of(h, WORD_BASE), start, np.minimum(start + size, wo[1:][doc]), WORD_BASE)
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])]) if len(sh) else np.zeros(0, bool)
    return sh[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def digests(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sh ^ U64(0x6A09E667F3BCC909)), dtype=U64)])
    return mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(U64) * U64(0xA24BAED4963EE407))


def prefix_sizes(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements of a set of n, one of which it shares with any set of similarity num/den or more."""
    return np.where(n > 0, n - (num * n + den - 1) // den + 1, 0)


def sketches(sh: np.ndarray, off: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """For each set, `words` words of parities: bit i tells whether an odd number of elements falls on it."""
    m, bits = len(off) - 1, 64 * words
    at = (mix(sh ^ U64(0xBB67AE8584CAA73B)) % U64(bits)).astype(np.int64)
    out = np.zeros((m, words), U64)
    step = max(1, (1 << 20) // bits)
    for k in range(0, m, step):
        e = min(k + step, m)
        cell = np.bincount(np.repeat(np.arange(e - k), np.diff(off[k : e + 1])) * bits + at[off[k] : off[e]], minlength=(e - k) * bits) & 1
        out[k:e] = np.packbits(cell.astype(np.uint8).reshape(e - k, -1), axis=1, bitorder="little").view(U64)
    return out


def wide_sketches(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of a power of two of words, two bits an element at least, end to end, and their offsets."""
    n = np.diff(off)
    words = 1 << np.ceil(np.log2(np.maximum(n / 32, 4))).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(edges[-1], U64)
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        k = n[own]
        sk = sketches(sh[np.repeat(off[own], k) + spread(k)], np.concatenate([[0], np.cumsum(k)]), int(w))
        out[np.repeat(edges[own], w) + spread(np.full(len(own), w))] = sk.reshape(-1)
    return out, edges


def _lists(flat: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.view(np.int64)))


def _chunks(batches, size, column):
    for b in batches:
        data, off = buffer_of(b.column(column))
        for x, y in slices(off, 1 << 19):
            yield b.slice(x, y - x), *shingle_sets(data[off[x] : off[y]], off[x : y + 1] - off[x], size)


def _prefixes(sh, off, num, den, late):
    """The first elements of each set by their level in the filter `late`, then by hash."""
    n = np.diff(off)
    sh = sh[np.lexsort((sh, late.levels(sh), np.repeat(np.arange(len(n)), n)))]
    p = prefix_sizes(n, num, den)
    return sh[np.repeat(off[:-1], p) + spread(p)], np.concatenate([[0], np.cumsum(p)])


def _magnitude(n):
    return np.log2(n).astype(np.int64)


def _sample_rows(batches, size):
    for _, sh, _ in _chunks(batches, size, 0):
        u, c = bloom.counted(sh)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "n"])


def _set_rows(batches, size, num, den, late):
    for b, sh, off in _chunks(batches, size, 2):
        pre, edges = _prefixes(sh, off, num, den, late)
        sk = sketches(sh, off)
        fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(2)), U64, b.num_rows)
        cols = [b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array(digests(sh, off).view(np.int64)), pa.array(np.diff(off)), _lists(pre, edges), _lists(sk.reshape(-1), np.arange(len(off)) * SKETCH), _lists(*wide_sketches(sh, off))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "fp", "s", "n", "prefix", "sketch", "wide"])


def _met_rows(batches, again):
    """(h, s, n, sketch, place, before) of the prefix elements in `again`; a filter's false positives meet nobody.

    place: how many elements of its set come before h; before: the last of them in `again`, h itself if there is none.
    """
    for b in batches:
        lists = b.column(2)
        h, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        keep = np.flatnonzero(again.contains(h.view(U64)))
        row, place, h = np.repeat(np.arange(len(size)), size)[keep], spread(size)[keep].astype(np.int32), h[keep]
        before = np.where(row == np.concatenate([[-1], row[:-1]]), np.concatenate([h[:1], h[:-1]]), h)
        for k in range(0, len(keep), 1 << 16):
            e = slice(k, k + (1 << 16))
            r = pa.array(row[e])
            yield pa.RecordBatch.from_arrays([pa.array(h[e]), *(b.column(i).take(r) for i in (0, 1, 3)), pa.array(place[e]), pa.array(before[e])], ["h", "s", "n", "sketch", "place", "before"])


def _buckets(batches):
    """Rows of batches sorted by h as (h, s, n, label, sketch, place, before), cut where h changes. Without the last two, h counts as each set's first element."""
    held = []
    for b in batches:
        if b.num_rows:
            h, s, n, l = (b.column(i).to_numpy() for i in range(4))
            place, before = (b.column(i).to_numpy() for i in (5, 6)) if b.num_columns > 5 else (np.zeros(len(h), np.int32), h)
            held.append((h, s, n, l, b.column(4).flatten().to_numpy().view(U64).reshape(-1, SKETCH), place, before))
            new = np.flatnonzero(h[1:] != h[:-1])
            whole = int(new[-1]) + 1 if len(new) else 0
            if whole or (len(held) > 1 and held[-2][0][-1] != h[0]):
                all_ = [np.concatenate(x) for x in zip(*held)]
                cut = len(all_[0]) - (len(h) - whole)
                yield [x[:cut] for x in all_]
                held = [tuple(x[cut:] for x in all_)]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _may_be_near(x, a, b, num, den):
    """Which index pairs pass the exact bounds, and the differing sketch bits of each.

    A pair of similarity num/den or more passes where its first common element stands, though maybe not at later ones: there no element before
    is common, so the overlap is what is left of either set at most.
    """
    h, _, n, label, sk, place, before = x
    total = n[a] + n[b]
    first = ((before[a] != before[b]) | (before[a] == h[a])) & ((num + den) * np.minimum(n[a] - place[a], n[b] - place[b]) >= num * total)
    ok = np.flatnonzero(first & (label[a] != label[b]) & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])))
    diff = np.bitwise_count(sk[a[ok]] ^ sk[b[ok]]).sum(1, dtype=np.int64)
    good = (num + den) * diff <= (den - num) * total[ok]
    return ok[good], diff[good]


def _pair_batch(x, a, b):
    p, q = np.minimum(x[1][a], x[1][b]), np.maximum(x[1][a], x[1][b])
    u = np.unique(np.stack([p, q], 1), axis=0) if len(p) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, i])) for i in range(2)], ["a", "b"])


def _few_pairs(batches, num, den, turn):
    """For each set of a bucket the TAKE likeliest of the LOOK next ones that are not connected with it yet."""
    for x in _buckets(batches):
        order = np.lexsort((mix(x[1].view(U64) + U64(turn)) if turn else x[2], x[0]))
        x = [v[order] for v in x]
        i = np.arange(len(x[0]))
        aa, bb, dd = [], [], []
        for d in range(1, LOOK + 1):
            a = i[:-d][x[0][d:] == x[0][:-d]] if d < len(i) else i[:0]
            if not len(a):
                break
            ok, diff = _may_be_near(x, a, a + d, num, den)
            aa.append(a[ok])
            bb.append(a[ok] + d)
            dd.append(diff)
        if aa:
            a, b, d = (np.concatenate(v) for v in (aa, bb, dd))
            o = np.lexsort((d, a))
            a, b = a[o], b[o]
            take = spread(runs(a)[1]) < TAKE
            yield _pair_batch(x, a[take], b[take])


def _all_pairs(batches, num, den):
    """Every pair of a bucket that is not connected yet and passes the bounds."""
    for x in _buckets(batches):
        order = np.lexsort((x[2], x[0]))
        x = [v[order] for v in x]
        head, length = runs(x[0])
        few = np.repeat((length > 1) & (length <= BLOCK), length)
        for c in range(1, int(length[length <= BLOCK].max(initial=1))):
            a = np.flatnonzero(few[:-c] & (x[0][c:] == x[0][:-c]))
            if not len(a):
                break
            ok, _ = _may_be_near(x, a, a + c, num, den)
            if len(ok):
                yield _pair_batch(x, a[ok], a[ok] + c)
        for s, m in zip(head[length > BLOCK], length[length > BLOCK]):
            if (x[3][s : s + m] == x[3][s]).all():
                continue
            for i in range(s, s + m, BLOCK):
                for j in range(i, s + m, BLOCK):
                    e, f = min(i + BLOCK, s + m), min(j + BLOCK, s + m)
                    if den * x[2][e - 1] < num * x[2][j]:  # sizes only grow from here
                        break
                    a, b = (v.reshape(-1) for v in np.meshgrid(np.arange(i, e), np.arange(j, f), indexing="ij"))
                    a, b = a[a < b], b[a < b]
                    ok, _ = _may_be_near(x, a, b, num, den)
                    if len(ok):
                        yield _pair_batch(x, a[ok], b[ok])


def _wanted_sets(batches, size, wanted):
    for _, sh, off in _chunks(batches, size, 0):
        s = digests(sh, off)
        keep = np.flatnonzero(wanted.contains(mix(s)))
        n = np.diff(off)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), _lists(sh[np.repeat(off[keep], n) + spread(n)], np.concatenate([[0], np.cumsum(n)]))], ["s", "els"])


def _ends(batches):
    for b in batches:
        u = np.unique(np.concatenate([b.column(i).to_numpy() for i in range(2)]))
        yield pa.RecordBatch.from_arrays([pa.array(mix(u.view(U64)).view(np.int64)), pa.array(np.ones(len(u), np.int64))], ["h", "n"])


def _wanted_sketches(batches, wanted):
    for b in batches:
        yield b.filter(pa.array(wanted.contains(mix(b.column(0).to_numpy().view(U64)))))


def _folded(lists: pa.Array, rows: np.ndarray, words: int, to: int) -> np.ndarray:
    """Sketches of `words` words each, folded to `to` words: a set's sketch of that width."""
    flat = lists.take(pa.array(rows)).flatten().to_numpy().view(U64).reshape(len(rows), words // to, to)
    return np.bitwise_xor.reduce(flat, axis=1)


def _close(batches, num, den):
    """Pairs (a, b) of those with sizes and wide sketches that these bounds leave."""
    for big in batches:
        for k in range(0, big.num_rows, 1000):
            b = big.slice(k, 1000)
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            wa, wb = (b.column(i).value_lengths().to_numpy() for i in (4, 5))
            good = np.zeros(b.num_rows, bool)
            for p, q in {*zip(wa.tolist(), wb.tolist())}:
                rows = np.flatnonzero((wa == p) & (wb == q))
                x, y = _folded(b.column(4), rows, p, min(p, q)), _folded(b.column(5), rows, q, min(p, q))
                good[rows] = (num + den) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (den - num) * total[rows]
            yield b.select([0, 1]).filter(pa.array(good))


def _ends_of(pairs: DataFrame):
    return bloom.share(pairs.sparkSession, bloom.build(pairs.mapInArrow(_ends, "h long, n long")))


def _verified(text: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of digests whose sets are of similarity num/den or more, compared element by element."""
    ends = _ends_of(pairs)
    w = distinct.select("s", "n", "wide").mapInArrow(lambda it: _wanted_sketches(it, ends.value), "s long, n long, wide array<long>")
    both = pairs.join(w.toDF("a", "na", "wa"), "a").join(w.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")
    pairs = stored(both.mapInArrow(lambda it: _close(it, num, den), "a long, b long"), "near-close")
    wanted = _ends_of(pairs)
    sets = text.mapInArrow(lambda it: _wanted_sets(it, size, wanted.value), "s long, els array<long>").dropDuplicates(["s"])
    sets = stored(sets, "near-wanted")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    near = (num + den) * F.size(F.array_intersect("x", "y")) >= num * (F.size("x") + F.size("y"))
    return stored(both.where(near).select("a", "b"), "near-links")


def simhash_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that connect those with fingerprints within the radius: heads of near fingerprints, and each set with the head of its own."""
    heads = stored(distinct.groupBy("fp").agg(F.min("s").alias("head")), "near-fingerprints")
    links = near_links(heads.select("fp"))
    far = links.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select("x", "y")
    own = distinct.select("fp", F.col("s").alias("y")).join(heads, "fp").where("head <> y").select(F.col("head").alias("x"), "y")
    return far.unionByName(own).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, num: int = 4, den: int = 5, rounds: int = 1) -> DataFrame:
    """(doc_id, rk, component) for every row of docs (doc_id, rk long, text): rows have one component if links of similarity num/den or more connect them.

    SimHash pairs are verified first, then `rounds` rounds of few neighbours, then all pairs that share a prefix element and are still apart.
    Similarity is |A & B| / |A | B| of the sets of `size`-word shingles, ASCII letters lowered, words apart at ASCII white space. Equal sets
    are linked, so null and wordless texts are too. Shingles and sets are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct().mapInArrow(lambda it: _sample_rows(it, size), "h long, n long")
    late = bloom.share(spark, bloom.build(sample, max_bytes=FREQUENT, least=2, quantise=_magnitude))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "rk", F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _set_rows(it, size, num, den, late.value), f"doc_id {kind}, rk long, fp long, s long, n long, prefix array<long>, sketch array<long>, wide array<long>")
    rows = stored(rows, "near-sets")
    distinct = stored(rows.drop("doc_id", "rk").dropDuplicates(["s"]), "near-distinct")
    # the first common element of a pair leaves enough of the smaller set for an overlap with one as large: it counts twice there, and once at least in the other
    early = (num + den) * (F.col("n") - F.col("place")) >= 2 * num * F.col("n")
    counts = distinct.select("n", F.posexplode("prefix").alias("place", "h")).select("h", F.when(early, 2).otherwise(1).cast("long").alias("n"))
    again = bloom.share(spark, bloom.build(counts, least=3))
    met = stored(distinct.select("s", "n", "prefix", "sketch").mapInArrow(lambda it: _met_rows(it, again.value), "h long, s long, n long, sketch array<long>, place int, before long"), "near-met")
    links, label = None, None
    for turn in range(rounds + 2):
        if not turn:
            found = simhash_pairs(distinct)
        else:
            placed = met.withColumn("label", F.col("s")) if label is None else met.join(label, met["s"] == label["node"], "left").withColumn("label", F.coalesce("root", "s"))
            dealt = placed.select("h", "s", "n", "label", "sketch", "place", "before").repartition(parts(spark), "h").sortWithinPartitions("h")
            found = dealt.mapInArrow((lambda it, turn=turn: _few_pairs(it, num, den, turn)) if turn <= rounds else (lambda it: _all_pairs(it, num, den)), "a long, b long").distinct()
        pairs = stored(found, "near-pairs")
        if pairs.limit(1).count():
            new = _verified(text, distinct, pairs, size, num, den)
            links = new if links is None else links.unionByName(new)
            label = connected_components(links)
    if label is None:
        return rows.select("doc_id", "rk", F.col("s").alias("component"))
    return rows.select("doc_id", "rk", "s").join(label, F.col("s") == label["node"], "left").select("doc_id", "rk", F.coalesce("root", "s").alias("component"))
