"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere.

Where two places share 200 bytes, they share the least hash of the 48-byte strings in them, at one
offset: the window's owner. Owners are the rolling-hash triggers that parse each text; counted over
the corpus, those met once are dropped by a filter of bounded size, and with them the windows that
can't repeat. The stretch of windows that an owner has in a text is its snippet. Snippets meet by
owner, equal ones collapse to one with a count, and where an owner has several different ones, a
suffix order of their bytes by prefix-free parsing (module pfp) tells which windows repeat. Every
window belongs to one snippet, so tasks share nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bytewords import BASE, buffer_of, masked_runs, packed, position_of, range_hashes, runs, slices, sliding_min, spread, sums_of
from .common import parts, stored, texts
from .pfp import repeated_windows
from .substring_words import NO_ID, GROUP_BYTES, SECOND_BASE, joined_runs, whole_groups

U64 = np.uint64
GRAM = 48
#: Bytes of snippets that one suffix order takes together; an owner's snippets always stay together.
ORDER_BYTES = 1 << 19
#: Bytes of text that are hashed together: some two dozen arrays of eight bytes for each.
CHUNK_BYTES = 1 << 18
#: Rows that are cut together.
ROWS = 1000


def snippets(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Owners of the windows of some texts: (owner hash, first window, number of windows, text)."""
    sums = sums_of(data.astype(U64) + U64(1), BASE)
    n = len(data)
    if n < window:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z, sums
    at = np.arange(n - gram + 1)
    h = range_hashes(sums, at, at + gram, BASE)
    least = sliding_min(packed(h), window - gram + 1)
    size = np.diff(off)
    end = np.repeat(off[1:], size)[: len(least)]
    text = np.repeat(np.arange(len(size)), size)[: len(least)]
    least = np.where(np.arange(len(least)) + window <= end, least, ~U64(0))
    first, count = runs(least)
    keep = least[first] != ~U64(0)
    first, count = first[keep], count[keep]
    return h[position_of(least[first])], first, count, text[first], sums


def _chunks(batches):
    for b in batches:
        data, off = buffer_of(b.column(1))
        key = b.column(0).fill_null(NO_ID).to_numpy()
        for x, y in slices(off, CHUNK_BYTES):
            yield key[x:y], data[off[x] : off[y]], off[x : y + 1] - off[x]


def _owners(batches, window, gram):
    for _, data, off in _chunks(batches):
        yield snippets(data, off, window, gram)[0]


def _digests(sums, data, first, end):
    second = sums_of(data.astype(U64) + U64(1), SECOND_BASE)
    return range_hashes(sums, first, end, BASE), range_hashes(second, first, end, SECOND_BASE)


def _repeated(data, off, window, gram, often):
    k, first, count, text, sums = snippets(data, off, window, gram)
    keep = np.flatnonzero(often.contains(k))
    k, first, count, text = k[keep], first[keep], count[keep], text[keep]
    end = first + count + window - 1
    return (k, first, count, text, end, *_digests(sums, data, first, end))


def _snippet_rows(batches, window, gram, often):
    """(owner, digests, count, bytes), equal snippets of one chunk collapsed."""
    for _, data, off in _chunks(batches):
        k, first, count, text, end, d1, d2 = _repeated(data, off, window, gram, often)
        if not len(k):
            continue
        order = np.lexsort((d2, d1))
        new = np.flatnonzero(np.concatenate([[True], (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])]))
        pick, many = order[new], np.diff(np.append(new, len(order)))
        size = (end - first)[pick]
        body = data[np.repeat(first[pick], size) + spread(size)]
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(body.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(k[pick].view(np.int64)), pa.array(d1[pick].view(np.int64)), pa.array(d2[pick].view(np.int64)), pa.array(many), bodies], ["k", "d1", "d2", "many", "body"])


def _place_rows(batches, window, gram, often):
    for ids, data, off in _chunks(batches):
        _, first, count, text, _, d1, d2 = _repeated(data, off, window, gram, often)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1.view(np.int64), d2.view(np.int64), ids[text], first - off[text])], ["d1", "d2", "doc", "at"])


ORDERED = ["d1", "d2", "start", "number", "many", "body"]


def _order_rows(batches, window, most=GROUP_BYTES):
    """For each distinct snippet with repeated windows, their runs: (d1, d2, [start], [number]). Snippets of owners too large for a task pass."""
    for t, whole_ in whole_groups(batches, most=most):
        k, d1, d2, many = (t.column(i).to_numpy() for i in range(4))
        if not whole_:  # to be dealt by window: no lists yet
            none = pa.nulls(len(k), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), none, none, pa.array(many), t.column(4).combine_chunks()], ORDERED)
            continue
        order = np.lexsort((d2, d1, k))
        k, d1, d2 = k[order], d1[order], d2[order]
        new = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (k[1:] != k[:-1])]))
        total, pick = np.add.reduceat(many[order], new), order[new]
        k, d1, d2 = k[new], d1[new], d2[new]
        body, edge = buffer_of(t.column(4))
        size = np.diff(edge)[pick]
        head, length = runs(k)
        several = np.repeat(length > 1, length)
        whole = total > 1
        g, at, n = [np.flatnonzero(whole)], [np.zeros(whole.sum(), np.int64)], [(size - window + 1)[whole]]
        rows = np.flatnonzero(several)
        starts = rows[np.concatenate([[True], k[rows][1:] != k[rows][:-1]])] if len(rows) else rows
        a = 0
        while a < len(rows):  # whole owners, about ORDER_BYTES at a time
            b = a + max(1, int(np.searchsorted(np.cumsum(size[rows[a:]]), ORDER_BYTES, "right")))
            if b < len(rows):
                nxt = starts[np.searchsorted(starts, rows[b])] if np.searchsorted(starts, rows[b]) < len(starts) else None
                b = len(rows) if nxt is None else int(np.searchsorted(rows, nxt))
            own = rows[a:b]
            s = size[own]
            data = body[np.repeat(edge[:-1][pick[own]], s) + spread(s)]
            off = np.concatenate([[0], np.cumsum(s)])
            again = repeated_windows(data, off, window)
            gg, aa, nn = masked_runs(again, np.repeat(np.arange(len(own)), s))
            part = ~whole[own[gg]]
            g.append(own[gg][part])
            at.append((aa - off[gg])[part])
            n.append(nn[part])
            a = b
        g, at, n = np.concatenate(g), np.concatenate(at), np.concatenate(n)
        o = np.argsort(g, kind="stable")
        g, at, n = g[o], at[o], n[o]
        per = np.bincount(g, minlength=len(k))
        useful = np.flatnonzero(per)
        edges = pa.array(np.concatenate([[0], np.cumsum(per[useful])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(d1[useful]), pa.array(d2[useful]), pa.ListArray.from_arrays(edges, pa.array(at)), pa.ListArray.from_arrays(edges, pa.array(n)), pa.array(total[useful]), pa.nulls(len(useful), pa.binary())], ORDERED)


def _window_rows(batches, window):
    """(d1, d2, i, w1, w2, many): the windows of snippets (d1, d2, many, body), by two hashes of each."""
    for b in batches:
        body, edge = buffer_of(b.column(3))
        for x, y in slices(edge, CHUNK_BYTES):
            data, off = body[edge[x] : edge[y]], edge[x : y + 1] - edge[x]
            n = np.maximum(np.diff(off) - window + 1, 0)
            row, i = np.repeat(np.arange(y - x), n), spread(n)
            at = off[row] + i
            w1, w2 = _digests(sums_of(data.astype(U64) + U64(1), BASE), data, at, at + window)
            ends = [b.column(c).slice(x, y - x).take(pa.array(row)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*ends[:2], pa.array(i), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), ends[2]], ["d1", "d2", "i", "w1", "w2", "many"])


def _order_hot(rows: DataFrame, window: int) -> DataFrame:
    """What _order_rows says of whole owners, for those too large for a task: windows are dealt by their own hashes and only counts meet."""
    snippets_ = stored(rows.groupBy("d1", "d2").agg(F.sum("many").alias("many"), F.first("body").alias("body")), "suffix-hot")
    w = snippets_.mapInArrow(lambda it: _window_rows(it, window), "d1 long, d2 long, i long, w1 long, w2 long, many long")
    again = w.groupBy("w1", "w2").agg(F.sum("many").alias("times")).where("times > 1").select("w1", "w2")
    found = w.join(again, ["w1", "w2"]).groupBy("d1", "d2").agg(F.array_sort(F.collect_set("i")).alias("i")).withColumn("r", joined_runs("i"))
    return found.select("d1", "d2", F.col("r.s").alias("start"), F.col("r.n").alias("number"))


def cut(raw: bytes, spans: list[dict] | None, window: int) -> tuple[bytes, int, int]:
    """(rest, bytes removed, runs removed) of raw without what the runs of windows (s: first, n: number) cover."""
    left, done, gone, cuts, last = [], 0, 0, 0, -1
    for s in sorted(spans or (), key=lambda x: x["s"]):
        a, e = s["s"], s["s"] + s["n"] + window - 1
        if a > last:
            left.append(raw[done:a])
            cuts += 1
        gone += max(0, e - max(a, done))
        done = last = max(done, e)
    left.append(raw[done:])
    return b"".join(left), gone, cuts


def _encoded(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def few_rows(batches):
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def _cut_rows(batches, window):
    for b in few_rows(batches):
        raw = [_encoded(t) for t in b.column(1)]
        done = [cut(r, s.as_py(), window) for r, s in zip(raw, b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([x[0] for x in done], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(d: DataFrame, window: int, gram: int, max_filter_bytes: int, most: int = GROUP_BYTES) -> DataFrame:
    """(doc, spans): the runs of repeated windows of every document that has any, of d (doc_id long, text)."""
    spark = d.sparkSession
    often = bloom.share(spark, bloom.build(d.mapInArrow(lambda it: bloom.summed(_owners(it, window, gram)), "h long, n long"), least=2, max_bytes=max_filter_bytes))
    rows = d.mapInArrow(lambda it: _snippet_rows(it, window, gram, often.value), "k long, d1 long, d2 long, many long, body binary")
    ordered = rows.repartition(parts(spark), "k").sortWithinPartitions("k").mapInArrow(lambda it: _order_rows(it, window, most), "d1 long, d2 long, start array<long>, number array<long>, many long, body binary")
    ordered = stored(ordered, "suffix-snippets")
    hot, ordered = ordered.where("start IS NULL").drop("start", "number"), ordered.where("start IS NOT NULL").drop("many", "body")
    if hot.limit(1).count():
        ordered = ordered.unionByName(_order_hot(hot, window))
    places = d.mapInArrow(lambda it: _place_rows(it, window, gram, often.value), "d1 long, d2 long, doc long, at long")
    own = F.transform(F.arrays_zip("start", "number"), lambda x: F.struct((F.col("at") + x["start"]).alias("s"), x["number"].alias("n")))
    found = places.join(ordered, ["d1", "d2"]).select("doc", own.alias("spans")).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return stored(found, "suffix-spans")


def _with_spans(d: DataFrame, found: DataFrame) -> DataFrame:
    # The spans are the built side, so texts move once and are not sorted.
    return d.join(found.hint("shuffle_hash"), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc"), "left").drop("doc")


def dedup_bytes(docs: DataFrame, *, window: int = 200, gram: int = GRAM, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 256 << 20, most: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those that a repeated window covers.

    A window of a repeated row also starts elsewhere. Rows with one id are taken to hold one text: each of them loses what any loses. Null and
    empty texts have no bytes; null ids are kept. kept is binary, as a cut may fall inside a character; with digest=True, kept_sha256 in hex.
    """
    d = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = _with_spans(d, repeated_spans(d, window, gram, max_filter_bytes, most)).select("doc_id", "text", "spans")
    out = joined.mapInArrow(lambda it: _cut_rows(it, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept") if digest else out


def clean_documents(docs: DataFrame, *, window: int = 200, gram: int = GRAM, max_filter_bytes: int = 256 << 20) -> DataFrame:
    """docs (doc_id, text, n_chars and any others) with repeated bytes out of text, and n_chars counted anew where something went.

    Bytes of characters that a cut split are dropped. Rows stay, even those of which nothing is left.
    """
    d = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    spans = repeated_spans(d.select("doc_id", "text"), window, gram, max_filter_bytes)
    at, n_at = d.columns.index("text"), d.columns.index("n_chars")

    def run(batches):
        for b in few_rows(batches):
            texts_, sizes = [], []
            for t, n, s in zip(b.column(at), b.column(n_at), b.column(b.num_columns - 1)):
                if s.as_py():
                    left = cut(_encoded(t), s.as_py(), window)[0].decode("utf-8", "ignore")
                    texts_.append(left)
                    sizes.append(len(left))
                else:
                    texts_.append(t.as_py())
                    sizes.append(n.as_py())
            columns = b.columns[:-1]
            columns[at], columns[n_at] = pa.array(texts_, b.schema.field(at).type), pa.array(sizes, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return _with_spans(d, spans).mapInArrow(run, d.schema)
