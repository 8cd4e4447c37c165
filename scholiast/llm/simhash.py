"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints within r = 4 bits must meet. Each bit position i gets a non-zero vector m(i) of r+1
bits; for each non-zero vector v of r+1 bits there is a table whose mask holds the positions with
odd <m(i), v>, and a fingerprint's key in it is fingerprint AND mask. The positions in which two
near fingerprints differ have at most r vectors, which can't span all r+1 dimensions, so some v is
orthogonal to all of them: that table's mask avoids every difference and the two keys are equal
(Pagh, 2016). 31 tables thus miss no pair, whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stored, texts
from .components import connected_components, roots

U64 = np.uint64
RADIUS = 4
#: Runs of one key longer than this are split further instead of being compared pair by pair.
DENSE = 256


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks; positions take the non-zero vectors in turn, so every mask has about half of the bits."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, top)]


def fingerprint(text: str | None, size: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), U64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=U64))[2 * ones > n].sum(dtype=U64)) if n else 0


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; null and wordless texts have fingerprint zero."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(v.as_py(), size) for v in b.column(1)), U64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    d = texts(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def close_pairs(fp: np.ndarray, key: np.ndarray, radius: int, free: int = (1 << 64) - 1) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what pairs with equal key within the radius connect. key is sorted.

    Runs up to DENSE are compared by shifts. A longer run is cut by five blocks of the bits that may still differ: two values
    within four bits agree in one of them, so each block's equal values form shorter runs, treated alike. A run's links are
    reduced to a star for each component before they leave.
    """
    n = len(fp)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, int)
    size = np.diff(np.append(at, n))
    out_a, out_b = [], []
    for s, c in zip(at[size > DENSE], size[size > DENSE]):
        own = fp[s : s + c]
        varied = int(np.bitwise_or.reduce(own ^ own[0])) & free
        bits = [i for i in range(64) if varied >> i & 1]
        if len(bits) <= radius:  # all within the radius of each other
            out_a.append(np.full(c - 1, s))
            out_b.append(np.arange(s + 1, s + c))
            continue
        ea, eb = [], []
        for k in range(radius + 1):
            block = sum(1 << i for i in bits[k :: radius + 1])
            sub = own & U64(block)
            order = np.argsort(sub, kind="stable")
            a, b = close_pairs(own[order], sub[order], radius, free & ~block)
            ea.append(order[a])
            eb.append(order[b])
        root = roots(c, np.concatenate(ea), np.concatenate(eb))
        moved = np.flatnonzero(root != np.arange(c))
        out_a.append(s + root[moved])
        out_b.append(s + moved)
    few = np.repeat((size > 1) & (size <= DENSE), size)
    rows = np.flatnonzero(few)
    if len(rows):
        x, g = fp[rows], np.repeat(np.arange(len(size)), size)[rows]
        ea, eb = [], []
        for d in range(1, int(size[size <= DENSE].max())):
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            near = same[np.bitwise_count(x[same] ^ x[same + d]) <= radius]
            ea.append(near)
            eb.append(near + d)
        root = roots(len(rows), np.concatenate(ea), np.concatenate(eb))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        out_a.append(rows[root[moved]])
        out_b.append(rows[moved])
    z = np.zeros(0, int)
    return np.concatenate(out_a or [z]), np.concatenate(out_b or [z])


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints (fp) whose components are those of all pairs within the radius."""
    tables = covering_masks(radius)
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in tables))
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "m")).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")

    def run(batches):
        held = []  # the run of one key that is still open, in pieces
        for b in batches:
            if not b.num_rows:
                continue
            t, k, f = (b.column(i).to_numpy() for i in range(3))
            if held and (t[0] != held[-1][0][-1] or k[0] != held[-1][1][-1]):
                yield from emit(*map(np.concatenate, zip(*held)))
                held = []
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from emit(*map(np.concatenate, zip(*held, (t[:cut], k[:cut], f[:cut]))))
                held = []
            held.append((t[cut:], k[cut:], f[cut:]))
        if held:
            yield from emit(*map(np.concatenate, zip(*held)))

    def emit(t, k, f):
        run_no = np.cumsum(np.concatenate([[0], ((t[1:] != t[:-1]) | (k[1:] != k[:-1])).astype(int)]))
        a, b = close_pairs(f.view(U64), run_no, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], ["a", "b"])

    return keyed.repartition(parts(distinct.sparkSession), "t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = 4, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. Repeated rows repeat; null ids get
    their component's smallest id, or null if it has none.
    """
    fps = stored(fingerprints(docs, size, id_col, text_col), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(near_links(classes.select("fp"), radius))
    placed = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "simhash-classes")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = placed.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
