"""Suffix order of highly repetitive text by prefix-free parsing.

Texts are cut where the hash of eight bytes meets a condition; each phrase runs up to and including
the next such trigger. Equal stretches of text fall into equal phrases, so the dictionary of
distinct phrases is much smaller than the text. Two suffix arrays are built by prefix doubling: of
the dictionary's bytes and of the parse, the texts as sequences of phrase ranks. No suffix of a
phrase that starts before its final trigger is a prefix of another, hence the order of two places
in the texts is that of the rests of their phrases, and among equal rests that of the parse from the
next phrase on (Boucher et al., 2019).
"""

from __future__ import annotations

import numpy as np

from .bytewords import BASE, mix, range_hashes, spread, sums_of

U64 = np.uint64
TRIGGER = 8
#: Seven symbols of nine bits fill a first rank.
SYMBOLS = 7


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the distinct ones, whether it shares it)."""
    _, at, many = np.unique(keys, return_inverse=True, return_counts=True)
    return at.astype(np.int64), many[at] > 1


def doubling(keys: np.ndarray, rest: np.ndarray, have: int) -> np.ndarray:
    """Order-preserving ranks of whole sequences, from keys of their first `have` items; rest: items from each place to its sequence's end."""
    n = len(keys)
    rank, tied = ranks(keys)
    while (tied & (rest > have)).any():
        on = np.flatnonzero(rest > have)
        later = np.zeros(n, np.int64)
        later[on] = rank[on + have] + 1
        rank, tied = ranks(rank * np.int64(n + 1) + later)
        have *= 2
    return rank


def corpus_order(data: np.ndarray, off: np.ndarray, every: int = 16, room: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): places of the texts data[off[i]:off[i+1]] in suffix order, those with `room` bytes left, and the text of each place. Texts must not be empty."""
    n = len(data)
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    end = off[1:][text]
    eight = np.zeros(n, U64)
    for k in range(min(TRIGGER, n)):
        eight[: n - k] = (eight[: n - k] << U64(8)) | data[k:]
    cut = (mix(eight) % U64(every) == 0) & (np.arange(n) + TRIGGER <= end)
    cut[off[:-1]] = True
    start = np.flatnonzero(cut)
    phrase_text = text[start]
    stop = np.append(start[1:], n)
    last = np.append(phrase_text[1:] != phrase_text[:-1], True)
    stop = np.where(last, end[start], stop + TRIGGER)  # a phrase ends with the trigger that follows it

    # Dictionary: distinct phrases; one that ends a text differs from one that ends with a trigger.
    name = range_hashes(sums_of(data.astype(U64) + U64(1), BASE), start, stop, BASE) ^ (last.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, pick, which = np.unique(name, return_index=True, return_inverse=True)
    length = (stop - start)[pick]
    base = np.concatenate([[0], np.cumsum(length)])
    words = data[np.repeat(start[pick], length) + spread(length)].astype(np.int64) + 1
    rest = np.repeat(base[1:], length) - np.arange(base[-1])
    first = np.zeros(base[-1], np.int64)
    for k in range(SYMBOLS):
        first <<= 9
        on = np.flatnonzero(rest > k)
        first[on] |= words[on + k]
    suffix = doubling(first, rest, SYMBOLS)

    # Parse: ranks of the phrases, then of the phrase sequences from each place to the end of its text.
    ends = np.searchsorted(start, off[1:])
    parse = doubling(suffix[base[:-1]][which], ends[phrase_text] - np.arange(len(start)), 1)

    places = np.flatnonzero(np.arange(n) + room <= end)
    phrase = (np.cumsum(cut) - 1)[places]
    inner = suffix[base[:-1][which[phrase]] + places - start[phrase]]
    follow = np.where(last[phrase], 0, parse[np.minimum(phrase + 1, len(start) - 1)] + 1)
    return places[np.argsort(inner * np.int64(len(start) + 2) + follow, kind="stable")], text


def shared_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the `most` bytes from a[i] and from b[i] on are the same, compared eight at a time as far as they agree. Both must lie within data."""
    eight = np.zeros(len(data), U64)
    for k in range(min(TRIGGER, len(data))):
        eight[: len(data) - k] |= data[k:].astype(U64) << U64(8 * k)
    left = np.arange(len(a))
    at = sorted({*range(0, most - TRIGGER + 1, TRIGGER), most - TRIGGER}) if most >= TRIGGER else []
    for k in at:
        left = left[eight[a[left] + k] == eight[b[left] + k]]
    if most < TRIGGER:
        for k in range(most):
            left = left[data[a[left] + k] == data[b[left] + k]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def repeated_windows(data: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """For each place of the texts, whether its `window` bytes lie within its text and also start at another place of them.

    Places that share a window are neighbours in suffix order, so each place is compared with the next one there, byte by byte.
    """
    n = len(data)
    out = np.zeros(n, bool)
    if not n:
        return out
    order, _ = corpus_order(data, off, room=window)
    same = shared_bytes(data, order[1:], order[:-1], window)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
