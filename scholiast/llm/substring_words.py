"""Substring dedup over words by fixed-block anchors.

The index holds the non-overlapping blocks of every document: words 0-9, 10-19 and so on. A window
of 20 words that occurs earlier covers one whole block of the earlier document, so the same ten
words stand at some place of the later window, at whatever phase: every rolling ten-word window of
every document probes the index. Probes and blocks that are met at two places or more are anchors.
Whether a place is an anchor depends on its words alone, so all occurrences of a 20-word window see
the same anchors, and the one of least hash owns the window in each of them. Around an owner, the
hit is extended: the windows it owns, as one stretch of words, are its context. Equal contexts
collapse to a class with its earliest place; only owners with several classes need a comparison of
their windows, in the task that holds the owner's key.

Index and anchors are Bloom filters of bounded size; a false positive makes a candidate that finds
no partner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bytewords import WORD_BASE, buffer_of, masked_runs, packed, position_of, range_hashes, runs, slices, sliding_min, span_hashes, spread, sums_of, window_hashes, word_spans
from .common import parts, stored, texts

U64 = np.uint64
SECOND_BASE = 0xF1357AEA2E62A9C5
NO_ID = np.iinfo(np.int64).min
#: Bytes of text that are hashed together: some two dozen arrays of eight bytes for each.
CHUNK_BYTES = 1 << 19
#: Bytes of one owner's rows that a task gathers; the rows of a larger owner are dealt again by window.
GROUP_BYTES = 32 << 20


class Words:
    """Word hashes of some texts, end to end, and where each text's words are."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        s, e, wo = word_spans(data, off)
        self.h = span_hashes(data, s, e)
        self.n = np.diff(wo)
        self.first = np.repeat(wo[:-1], self.n)
        self.doc = np.repeat(np.arange(len(off) - 1), self.n)
        self.end = np.repeat(wo[1:], self.n)

    def inside(self, size: int) -> np.ndarray:
        """Which of the len-size+1 windows lie within one text."""
        m = max(0, len(self.h) - size + 1)
        return np.arange(m) + size <= self.end[:m]

    def at(self) -> np.ndarray:
        return np.arange(len(self.h)) - self.first


def chunks(batches, ids: bool = True):
    """(ids, Words) of about CHUNK_BYTES of text at a time; a null id becomes the least long."""
    for b in batches:
        data, off = buffer_of(b.column(1))
        key = b.column(0).fill_null(NO_ID).to_numpy() if ids else None
        for x, y in slices(off, CHUNK_BYTES):
            yield key[x:y] if ids else None, Words(data[off[x] : off[y]], off[x : y + 1] - off[x])


def _blocks(batches, block):
    for _, w in chunks(batches):
        g, ok = window_hashes(w.h, block), w.inside(block)
        yield g[ok & (w.at()[: len(g)] % block == 0)]


def _probes(batches, block, index):
    for _, w in chunks(batches):
        g, ok = window_hashes(w.h, block), w.inside(block)
        hit = ok & (w.at()[: len(g)] % block == 0)
        rest = np.flatnonzero(ok & ~hit)
        hit[rest[index.contains(g[rest])]] = True
        yield g[hit]


def owned(w: Words, window: int, block: int, anchors: bloom.Filter):
    """Contexts of some texts: the owner's hash, first window, number of windows and two digests for each, and all windows' hashes."""
    g = window_hashes(w.h, block)
    ok = w.inside(block)
    at = np.flatnonzero(ok)
    anchor = np.zeros(len(g), bool)
    anchor[at[anchors.contains(g[at])]] = True
    keys = np.where(anchor, packed(g), ~U64(0))
    least = sliding_min(keys, window - block + 1)
    inside = w.inside(window)
    least = np.where(inside, least[: len(inside)], ~U64(0))
    first, count = runs(least)
    keep = least[first] != ~U64(0)
    first, count = first[keep], count[keep]
    owner = position_of(least[first])
    a = sums_of(w.h, WORD_BASE)
    b = sums_of(w.h, SECOND_BASE)
    end = first + count + window - 1
    return g[owner], first, count, range_hashes(a, first, end, WORD_BASE), range_hashes(b, first, end, SECOND_BASE), window_hashes(w.h, window)


def _class_rows(batches, window, block, anchors):
    schema = pa.schema([("k", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64()), ("many", pa.int64()), ("wh", pa.list_(pa.int64()))])
    for ids, w in chunks(batches):
        k, first, count, d1, d2, wh = owned(w, window, block, anchors)
        if not len(k):
            continue
        doc, pos = ids[w.doc[first]], first - w.first[first]
        order = np.lexsort((pos, doc, d2, d1))
        d1, d2 = d1[order], d2[order]
        new = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
        pick = order[new]
        many = np.diff(np.append(new, len(order)))
        c = count[pick]
        flat = wh[np.repeat(first[pick], c) + spread(c)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32)), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[pick].view(np.int64), d1[new].view(np.int64), d2[new].view(np.int64), doc[pick], pos[pick], many)] + [lists], schema=schema)


def _place_rows(batches, window, block, anchors):
    for ids, w in chunks(batches):
        _, first, count, d1, d2, _ = owned(w, window, block, anchors)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1.view(np.int64), d2.view(np.int64), ids[w.doc[first]], first - w.first[first], count)], ["d1", "d2", "doc", "pos", "count"])


def whole_groups(batches, column: int = 0, most: int = GROUP_BYTES):
    """(table, whole): batches sorted by one column, cut only where its value changes.

    A value whose rows exceed `most` bytes is not gathered: its rows come in tables that are not whole, and hold that value alone.
    """
    held: list[pa.RecordBatch] = []
    size, hot = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        if hot is not None:
            n = int(np.searchsorted(v, hot, "right"))
            if n:
                yield pa.Table.from_batches([b.slice(0, n)]).combine_chunks(), False
            if n == len(v):
                continue
            hot, b, v = None, b.slice(n), v[n:]
        cut = np.flatnonzero(v[1:] != v[:-1])
        last = int(cut[-1]) + 1 if len(cut) else 0
        if held and v[0] != held[-1].column(column)[held[-1].num_rows - 1].as_py():
            yield pa.Table.from_batches(held).combine_chunks(), True
            held, size = [], 0
        if last:
            first = int(cut[0]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, first)]).combine_chunks(), True
            if last > first:
                yield pa.Table.from_batches([b.slice(first, last - first)]).combine_chunks(), True
            held, size = [], 0
        held.append(b.slice(last))
        size += b.nbytes * (b.num_rows - last) // b.num_rows
        if size > most:
            hot = v[-1]
            for x in held:
                yield pa.Table.from_batches([x]).combine_chunks(), False
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), True


JUDGED = ["d1", "d2", "mdoc", "mpos", "at", "len", "many", "wh"]


def _judge(batches, most=GROUP_BYTES):
    """Classes of whole owners: the earliest place of each, and which of its windows there occur earlier in another class. Rows of owners too large pass."""
    for t, whole in whole_groups(batches, most=most):
        k, d1, d2, doc, pos, many = (t.column(i).to_numpy() for i in range(6))
        if not whole:  # to be dealt by window: no lists yet
            none = pa.nulls(len(k), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (d1, d2, doc, pos)), none, none, pa.array(many), t.column(6).combine_chunks()], JUDGED)
            continue
        lists = t.column(6).combine_chunks()
        flat, lo = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        order = np.lexsort((pos, doc, d2, d1))
        new = np.flatnonzero(np.concatenate([[True], (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])]))
        pick = order[new]
        total = np.add.reduceat(many[order], new)
        size = (lo[1:] - lo[:-1])[pick]
        wh = flat[np.repeat(lo[pick], size) + spread(size)]
        of = np.repeat(np.arange(len(pick)), size)
        wd, wp = doc[pick][of], pos[pick][of] + spread(size)
        o = np.lexsort((wp, wd, wh))
        head, length = runs(wh[o])
        least_d, least_p = np.repeat(wd[o][head], length), np.repeat(wp[o][head], length)
        late = np.zeros(len(wh), bool)
        late[o] = (wd[o] != least_d) | (wp[o] != least_p)
        g, at, n = masked_runs(late, of)
        start = at - (np.cumsum(size) - size)[g] if len(g) else at
        per = np.bincount(g, minlength=len(pick))
        useful = (per > 0) | (total > 1)
        edges = pa.array(np.concatenate([[0], np.cumsum(per[useful])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(d1[pick][useful]), pa.array(d2[pick][useful]), pa.array(doc[pick][useful]), pa.array(pos[pick][useful]), pa.ListArray.from_arrays(edges, pa.array(start)), pa.ListArray.from_arrays(edges, pa.array(n)), pa.array(total[useful]), pa.nulls(int(useful.sum()), pa.list_(pa.int64()))],
            JUDGED,
        )


def joined_runs(at: str):
    """[(s, n)] of consecutive numbers in a sorted array column."""
    zero = F.array().cast("array<struct<s:bigint,n:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["s"] + F.get(acc, F.size(acc) - 1)["n"] == x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), (last(acc)["n"] + 1).alias("n"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("s"), F.lit(1).cast("long").alias("n")))))
    return F.aggregate(at, zero, grow)


def _judge_hot(rows: DataFrame) -> DataFrame:
    """What _judge says of whole owners, for those too large for a task: windows are dealt by their own hash and only minima meet."""
    least = F.min(F.struct("mdoc", "mpos")).alias("p")
    classes = rows.groupBy("d1", "d2").agg(least, F.sum("many").alias("many"), F.first("wh").alias("wh")).select("d1", "d2", F.col("p.mdoc").alias("mdoc"), F.col("p.mpos").alias("mpos"), "many", "wh")
    classes = stored(classes, "substring-hot")
    w = classes.select("d1", "d2", "mdoc", "mpos", F.posexplode("wh").alias("i", "w")).withColumn("p", F.struct("mdoc", (F.col("mpos") + F.col("i")).alias("pos")))
    first = w.groupBy("w").agg(F.min("p").alias("least"))
    late = w.join(first, "w").where(F.col("p") != F.col("least")).groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.col("i").cast("long"))).alias("i"))
    runs_ = classes.drop("wh").join(late, ["d1", "d2"], "left").withColumn("r", joined_runs("i"))
    empty = F.array().cast("array<bigint>")
    return runs_.where("many > 1 OR i IS NOT NULL").select("d1", "d2", "mdoc", "mpos", F.coalesce(F.col("r.s"), empty).alias("at"), F.coalesce(F.col("r.n"), empty).alias("len"))


def _cut_rows(batches, window):
    """Removes the words that the windows named by (start, number) lists cover."""
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(b.column(1), b.column(2)):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            left, done, gone = [], 0, 0
            for s in sorted(spans.as_py() or (), key=lambda x: x["s"]):
                a, e = s["s"], s["s"] + s["n"] + window - 1
                if a > done:
                    left += words[done:a]
                gone += max(0, e - max(a, done))
                done = max(done, e)
            left += words[done:]
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup_words(docs: DataFrame, *, window: int = 20, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 256 << 20, most: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a window repeated from an earlier place covers.

    Earlier means a smaller doc_id, or an earlier start in the same document. A null id is smaller than all others; rows with one id are
    taken to be one document, so a repeated row is not earlier than its twin and both lose the same words. Null and empty texts have no
    words. kept is the rest of the words joined by blanks, or with digest=True kept_sha256, its SHA-256 in hex.
    """
    spark, block = docs.sparkSession, window // 2
    d = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    index = bloom.share(spark, bloom.build(d.mapInArrow(lambda it: bloom.summed(_blocks(it, block)), "h long, n long"), max_bytes=max_filter_bytes))
    probed = d.mapInArrow(lambda it: bloom.summed(_probes(it, block, index.value)), "h long, n long")
    anchors = bloom.share(spark, bloom.build(probed, least=2, max_bytes=max_filter_bytes))
    classes = d.mapInArrow(lambda it: _class_rows(it, window, block, anchors.value), "k long, d1 long, d2 long, doc long, pos long, many long, wh array<long>")
    judged = classes.repartition(parts(spark), "k").sortWithinPartitions("k").mapInArrow(lambda it: _judge(it, most), "d1 long, d2 long, mdoc long, mpos long, at array<long>, len array<long>, many long, wh array<long>")
    judged = stored(judged, "substring-classes")
    hot, judged = judged.where("at IS NULL"), judged.where("at IS NOT NULL").drop("many", "wh")
    if hot.limit(1).count():
        judged = judged.unionByName(_judge_hot(hot))
    places = d.mapInArrow(lambda it: _place_rows(it, window, block, anchors.value), "d1 long, d2 long, doc long, pos long, count long")
    met = places.join(judged, ["d1", "d2"])
    first = (F.col("doc") == F.col("mdoc")) & (F.col("pos") == F.col("mpos"))
    own = F.transform(F.arrays_zip("at", "len"), lambda x: F.struct((F.col("pos") + x["at"]).alias("s"), x["len"].alias("n")))
    spans = F.when(first, own).otherwise(F.array(F.struct(F.col("pos").alias("s"), F.col("count").alias("n"))))
    found = met.select("doc", spans.alias("spans")).where(F.size("spans") > 0).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = stored(found, "substring-spans")
    joined = d.join(found.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), "left").select("doc_id", "text", "spans")
    return _digested(joined.mapInArrow(lambda it: _cut_rows(it, window), "doc_id long, n_words long, n_removed long, kept binary"), digest)


def _digested(out: DataFrame, digest: bool) -> DataFrame:
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept") if digest else out.withColumn("kept", F.col("kept").cast("string"))
