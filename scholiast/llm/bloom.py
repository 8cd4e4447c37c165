"""Segmented Bloom filters, built by a shuffle and broadcast under a fixed bound.

The low bits of a 64-bit hash name one of SEGMENTS segments; hashes that were chosen as the least of several
crowd at low values, but not in their low bits. Each reduce task owns whole segments,
sizes them by what they hold, and sends only their bits. The sum of all segments never exceeds
max_bytes: past that the false-positive rate rises, which costs its users work or precision but
never an entry, since a filter has no false negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix
from .common import parts

U64 = np.uint64
SEGMENT_BITS = 10
SEGMENTS = 1 << SEGMENT_BITS


class Filter:
    """Membership of 64-bit hashes. Picklable; fixed once built."""

    def __init__(self, names: np.ndarray, bits: pa.Array, probes: int):
        """names: the segment of each element of the binary array bits."""
        self.probes = probes
        order = np.argsort(names)
        size = np.zeros(SEGMENTS, np.int64)
        size[names] = [len(bits[i].as_buffer()) for i in range(len(names))]
        self.start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) * 8
        self.size = (size * 8).astype(U64)
        self.data = np.zeros(max(1, int(size.sum())), np.uint8)
        for i in order:
            at = self.start[names[i]] // 8
            self.data[at : at + size[names[i]]] = np.frombuffer(bits[i].as_buffer(), np.uint8)

    @property
    def nbytes(self) -> int:
        return len(self.data)

    def fill(self) -> float:
        return float(np.unpackbits(self.data).mean())

    def contains(self, h: np.ndarray, level: int = 0) -> np.ndarray:
        """For each uint64 hash, whether it may be a member at that level. Later probes look only at what earlier ones left."""
        seg = (h & U64(SEGMENTS - 1)).astype(np.int64)
        left = np.flatnonzero(self.size[seg] > 0)
        for k in range(self.probes):
            s = seg[left]
            at = self.start[s] + positions(h[left], self.size[s], level * self.probes + k).astype(np.int64)
            left = left[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out

    def levels(self, h: np.ndarray, most: int = 64) -> np.ndarray:
        """For each hash, how many levels hold it from the first on: one membership question a level, until the first no or `most`."""
        out = np.zeros(len(h), np.int64)
        left, level = np.arange(len(h)), 0
        while len(left) and level < most:
            left = left[self.contains(h[left], level)]
            level += 1
            out[left] = level
        return out


def positions(h: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bit k of each hash in a segment of `size` bits, less than 2**32."""
    return (mix(h + U64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U64(32)) * size >> U64(32)


def segments(hashes: DataFrame, *, least: int = 1, bits_per_entry: int = 8, probes: int = 3, max_bytes: int | None = None, quantise=None) -> DataFrame:
    """(seg, bits): the segments of a filter of every h whose counts n sum to `least` or more; without max_bytes their sizes grow with what they hold.

    hashes: (h long, n long), pre-summed by the caller as far as it can. Rows meet by segment, so one shuffle serves both the sums and the bits; segments are hash-uniform, whatever the data.
    With quantise, a function of counts, an entry is held at the levels 0 to quantise(n) - 1, else at level 0 alone.
    """
    spark = hashes.sparkSession
    most = (1 << 32) - 8 if max_bytes is None else max(64, max_bytes // SEGMENTS * 8)
    seg = F.col("h").bitwiseAND(F.lit(SEGMENTS - 1)).cast("int")
    dealt = hashes.select(seg.alias("seg"), "h", "n").repartition(parts(spark), "seg")
    summed = dealt.groupBy("seg", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("seg", "h", "n")

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            s, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
            q = quantise(b.column(2).to_numpy()).astype(np.int16) if quantise else np.ones(len(h), np.int16)
            order = np.argsort(s, kind="stable")
            s, h, q = s[order], h[order], q[order]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else []
            for a, e in zip(cut, [*cut[1:], len(s)]):
                held.setdefault(int(s[a]), []).append((h[a:e], q[a:e]))
        for s, many in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack(*(np.concatenate(x) for x in zip(*many)), bits_per_entry, probes, most)], pa.binary())], ["seg", "bits"])

    return summed.mapInArrow(run, "seg int, bits binary")


def build(hashes: DataFrame, *, max_bytes: int = 256 << 20, probes: int = 3, **how) -> Filter:
    """The filter of all segments (see segments), of max_bytes at most."""
    return loaded(segments(hashes, max_bytes=max_bytes, probes=probes, **how), probes)


def loaded(segs: DataFrame, probes: int) -> Filter:
    """The filter of the segments (seg, bits) of a table; all other segments are empty in it."""
    got = segs.toArrow().combine_chunks()
    bits = got["bits"].combine_chunks() if isinstance(got["bits"], pa.ChunkedArray) else got["bits"]
    return Filter(got["seg"].to_numpy().astype(np.int64), bits, probes)


def pack(h: np.ndarray, q: np.ndarray, bits_per_entry: int, probes: int, most: int) -> bytes:
    size = min(most, max(64, int(q.sum()) * bits_per_entry)) // 8 * 8
    flat = np.zeros(size, np.uint8)
    for level in range(int(q.max())):
        own = h[q > level]
        for k in range(probes):
            flat[positions(own, U64(size), level * probes + k).astype(np.int64)] = 1
    return np.packbits(flat, bitorder="little").tobytes()


def counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their counts, for pre-summing in a map task."""
    if n is None:
        u, c = np.unique(h, return_counts=True)
        return u, c
    u, at = np.unique(h, return_inverse=True)
    return u, np.bincount(at, n, minlength=len(u)).astype(np.int64)


#: Hashes that a map task gathers before it sums them.
GATHER = 2_000_000


def summed(arrays, gather: int = GATHER):
    """Batches (h, n) of the distinct hashes of arrays and their counts, so that a frequent hash leaves a task in few rows."""
    held, size = [], 0
    for h in arrays:
        held.append(h)
        size += len(h)
        if size >= gather:
            yield _counts(held)
            held, size = [], 0
    if held:
        yield _counts(held)


def _counts(held: list) -> pa.RecordBatch:
    u, c = counted(np.concatenate(held))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "n"])


def share(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)
