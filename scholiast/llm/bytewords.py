"""Vectorised words over UTF-8 bytes: spans and 64-bit hashes of words and of word windows.

Everything works on one contiguous byte buffer holding many texts, so the cost is a few
numpy passes per byte and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd multipliers of the polynomial hashes; any odd constant works, these are fixed so that runs agree.
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, n + n // 16)
        out = np.full(size, U64(base), U64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser published with SplitMix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column end to end, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 20):
    """Ranges of texts that hold about `limit` bytes each; a longer text stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII letters lowered; all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that are not ASCII white space, and the n+1 word offsets of the texts.

    A word never crosses two texts, though nothing separates them in the buffer.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][(off[:-1] < off[1:])]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    ends_at = inside.copy()
    ends_at[:-1] &= ~(inside[1:] & ~begins[1:])
    ends = np.flatnonzero(ends_at) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Longer spans are hashed by XXH3 one by one: a polynomial modulo 2**64 takes some long strings for each other (Thue-Morse, from 1,024 bytes on).
LONG = 128


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial in an odd base modulo 2**64, shifted to position 0 and scrambled, or XXH3 where it is LONG."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    p = powers(base, len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * p[:-1], out=sums[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)
    out = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), base)
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive word hashes, len(words) - size + 1 of them; windows may cross texts, callers mask those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    p = powers(WORD_BASE, len(words) + 1)
    sums = np.empty(len(words) + 1, U64)
    sums[0] = 0
    np.cumsum(words * p[:-1], out=sums[1:])
    inverse = powers(pow(WORD_BASE, -1, 1 << 64), len(words) + 1)
    return mix((sums[size:] - sums[:-size]) * inverse[:n])


def sums_of(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums for polynomial hashes of any ranges of values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values) + 1)[: len(values)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each range, from sums_of(values, base)."""
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys, by doubling."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    m, have = keys, 1
    while 2 * have <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    return np.minimum(m[:n], m[width - have : width - have + n])


#: Low bits of a packed key that hold the position, counted from the end, so that the rightmost of equal hashes is least.
POSITION_BITS = 28
_LOW = U64((1 << POSITION_BITS) - 1)


def packed(hashes: np.ndarray) -> np.ndarray:
    """Keys whose minimum names the least hash (of its top 36 bits) and, among equal ones, the rightmost position."""
    return (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=U64))


def position_of(keys: np.ndarray) -> np.ndarray:
    return (_LOW - (keys & _LOW)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal neighbours."""
    if not len(values):
        z = np.zeros(0, np.int64)
        return z, z
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return at, np.diff(np.append(at, len(values)))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def masked_runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs that stay within one group: (group of each, first index, length)."""
    at = np.flatnonzero(mask)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (group[at[1:]] != group[at[:-1]])])
    first = np.flatnonzero(new)
    return group[at[first]], at[first], np.diff(np.append(first, len(at)))
