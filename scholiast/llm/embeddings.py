"""Embedding near-duplicates: sign hashing by random hyperplanes, exact verification, components.

Vectors of one label that are equal in every component form a class; classes are what is compared,
and their sizes enter the link counts. Each of several tables cuts the space by a number of hyperplanes. Two
classes that share a bucket are compared exactly; a pair that shares several is counted in the first
of them, which both sides can tell from their signatures. A bucket whose size passes BLOCK is dealt
in blocks, every pair of blocks to its own task, so that no task holds more than two blocks.

The number of planes grows with the logarithm of the number of vectors, so buckets of spread vectors do not
grow with the corpus, and the number of tables is what keeps the chance to miss a pair at the
threshold below MISS: at cosine 0.98 a plane separates a pair with probability 0.064, so sixteen tables of
twelve bits, or 32 of 21 bits for some 10^8 vectors. Closer pairs are missed less often still.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stored
from .components import connected_components, roots

BLOCK = 2048
#: Vectors to a bucket, were they spread evenly, and the least number of planes.
SPREAD, LEAST_BITS = 64, 12
MISS = 1e-4


def shape(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for n vectors: a pair at the threshold shares no bucket with probability below miss."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / SPREAD))))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-share)) if share < 1 else 1, bits


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one, scaled by their largest component first so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(v: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of rows p and q of v, in few rows at a time: each pair's sum is taken alone, so it is the same in any batch."""
    return np.concatenate([(v[p[k : k + 4096]] * v[q[k : k + 4096]]).sum(1) for k in range(0, len(p), 4096)] or [np.zeros(0)])


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for x in column:
        v = x.as_py()
        v = None if not v or any(c is None for c in v) else np.asarray(v, float)
        out.append(v if v is not None and np.isfinite(v).all() and v.any() else None)
    return out


def _sign_rows(batches, tables, bits, seed):
    """(id, label, vector bytes, class digest, table keys); unusable vectors have null bytes."""
    for b in batches:
        vs = _usable(b.column(1))
        body: list[bytes | None] = [None if v is None else (v + 0.0).tobytes() for v in vs]
        keys: list = [None] * len(vs)
        for dim in {len(v) for v in vs if v is not None}:
            rows = [i for i, v in enumerate(vs) if v is not None and len(v) == dim]
            sign = (unit(np.stack([vs[i] for i in rows])) @ planes(dim, tables, bits, seed) >= 0).reshape(len(rows), tables, bits)
            packed_ = (sign * (1 << np.arange(bits))).sum(2).astype(np.int32)
            for i, k in zip(rows, packed_):
                keys[i] = k.tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(body, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["vec_id", "label", "body", "keys"])


def _compare(batches, threshold):
    """Link counts and stars from rows (table, bucket, block pair, block, class, size, keys, body), sorted by task unit."""
    held: list[pa.RecordBatch] = []

    def unit_rows(table: pa.Table):
        g = table["g"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        t, side, i, j, many = (table[c].to_numpy() for c in ("t", "side", "bi", "bj", "many"))
        cid = table["cid"].to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(g), -1)
        body = table["body"].combine_chunks()
        left, right, count, star_a, star_b = [], [], [], [], []
        for a, e in zip(new, [*new[1:], len(g)]):
            if e - a < 2:
                continue
            v = unit(np.stack([np.frombuffer(body[k].as_py(), float) for k in range(a, e)]))
            own = i[a] == j[a]
            x = np.arange(e - a) if own else np.flatnonzero(side[a:e] == i[a])
            y = np.arange(e - a) if own else np.flatnonzero(side[a:e] == j[a])
            p, q = np.nonzero(v[x] @ v[y].T >= threshold - 1e-9)
            p, q = x[p], y[q]
            if own:
                p, q = p[p < q], q[p < q]
            keep = cosines(v, p, q) >= threshold
            first = (keys[a + p[keep]] == keys[a + q[keep]]).argmax(1) == t[a]
            p, q = p[keep], q[keep]
            star = roots(e - a, p, q)
            moved = np.flatnonzero(star != np.arange(e - a))
            star_a.append(cid[a + moved])
            star_b.append(cid[a + star[moved]])
            p, q = a + p[first], a + q[first]
            left += [cid[p], cid[q]]
            count += [many[q], many[p]]
        if left:
            c, at = np.unique(np.concatenate(left), return_inverse=True)
            n = np.bincount(at, np.concatenate(count), minlength=len(c)).astype(np.int64)
            a, b = np.concatenate(star_a), np.concatenate(star_b)
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c), pa.array(a)]), pa.concat_arrays([none(len(c)), pa.array(b)]), pa.concat_arrays([pa.array(n), none(len(a))])], ["a", "b", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        cut = np.flatnonzero(g[1:] != g[:-1])
        last = int(cut[-1]) + 1 if len(cut) else 0
        if held and g[0] != held[-1].column(0)[held[-1].num_rows - 1].as_py():
            yield from unit_rows(pa.Table.from_batches(held))
            held = []
        if last:
            yield from unit_rows(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        held.append(b.slice(last))
    if held:
        yield from unit_rows(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.98, miss: float = MISS, block: int = BLOCK, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors link if their labels are equal and not null and their cosine in double precision is `threshold` or more; null, empty and zero
    vectors and such with null or non-finite components link with nothing, nor do vectors of different length. Rows are what is counted, so
    a repeated row links with its twin. kept is vec_id = component_id; a null id is never kept. miss bounds the chance that a pair at the
    threshold is not compared.
    """
    spark = vectors.sparkSession
    tables, bits = shape(vectors.count(), threshold, miss)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    kind = v.schema["label"].dataType.simpleString()
    signed = v.mapInArrow(lambda it: _sign_rows(it, tables, bits, seed), f"vec_id long, label {kind}, body binary, keys array<int>")
    fit = F.col("label").isNotNull() & F.col("body").isNotNull()
    # The class id is a 64-bit hash of label and components; vectors are taken for equal if it is.
    rows = stored(signed.withColumn("cid", F.when(fit, F.xxhash64("label", "body"))), "embedding-rows")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("many"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("body").alias("body"), F.first("keys").alias("keys"))
    classes = stored(classes, "embedding-classes")

    # Buckets with two classes or more, by narrow rows; only their members bring vectors along.
    dim = F.octet_length("body")
    slots = classes.select("cid", "label", dim.alias("dim"), F.posexplode("keys").alias("t", "key")).withColumn("bucket", F.xxhash64("label", "dim", "t", "key")).select("cid", "t", "bucket")
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    member = slots.join(sizes, "bucket").withColumn("side", F.pmod(F.xxhash64("cid", F.lit(seed)), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("side", o).alias("i"), F.greatest("side", o).alias("j"))))
    dealt = member.withColumn("p", pair).select("cid", "t", "side", F.col("p.i").alias("bi"), F.col("p.j").alias("bj"), F.xxhash64("bucket", "p.i", "p.j").alias("g"))
    full = dealt.join(classes.select("cid", "many", "keys", "body"), "cid").select("g", "t", "side", "bi", "bj", "cid", "many", "keys", "body")
    compared = full.repartition(parts(spark), "g").sortWithinPartitions("g").mapInArrow(lambda it: _compare(it, threshold), "a long, b long, n long")
    compared = stored(compared, "embedding-links")
    links = compared.where("n IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = connected_components(compared.where("b IS NOT NULL").select("a", "b"))

    placed = classes.select("cid", "many", "first").join(links, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left").select("cid", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "first", F.coalesce("root", "cid").alias("root"))
    placed = stored(placed, "embedding-placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = placed.join(least, "root").select("cid", "n_links", "component_id")
    out = rows.select("vec_id", "cid").join(by_class, "cid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
