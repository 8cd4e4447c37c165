"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is the reduction of its leaves under an associative join. A leaf is a short
stretch of characters, encoded by itself. Two neighbours are joined by re-encoding a window
around their common edge: the window starts one span to the left of the edge and one to the
right and doubles until each of its ends is a *seam*. Tokens outside the window are then those
of the joined text, for this reason: a seam is a place where a character that is not white space
is followed by a blank or a line feed. No alternative of the splitting pattern matches a
character that is not white space followed by white space, so every left-to-right scan ends a
match there and starts the next one there, whatever lies before or after; its only look-ahead,
at the end of a white-space run, never reaches over a seam from the left. Merges act inside one
match, hence tokens never straddle a seam and depend on one side of it only. When no seam exists
in a half, the window grows to the whole half, so the join is right for every text.

Decoding is the homomorphism in the other direction: each leaf of ids gives its bytes, and bytes
are concatenated pairwise up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

_SEAM = re.compile(r"\S(?=[ \n])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class TreeBPE:
    """Encoder and decoder over one rank file.

    leaf: characters of a leaf. span: first width of a boundary window on either side.
    """

    def __init__(self, ranks_path: str, pattern: str, leaf: int = 1024, span: int = 64):
        import tiktoken

        self.ranks = read_ranks(ranks_path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self._encode = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.leaf, self.span = leaf, span

    def encode(self, text: str) -> list[int]:
        """Ids of text; an empty text has none."""
        return self._tree(text, 0, len(text)) if text else []

    def _tree(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self._encode(text[a:b])
        mid = (a + b) // 2
        left = self._tree(text, a, mid)
        return self._join(text, a, mid, b, left, self._tree(text, mid, b))

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        lo, hi = self._seam_before(text, a, mid), self._seam_after(text, mid, b)
        if lo == mid or hi == mid:  # the edge itself is a seam: nothing can change
            left.extend(right)
            return left
        cut = self._count_back(left, len(text[lo:mid].encode()))
        skip = self._count_forward(right, len(text[mid:hi].encode()))
        del left[cut:]
        left += self._encode(text[lo:hi])
        left += right[skip:] if skip else right
        return left

    def _seam_before(self, text: str, a: int, mid: int) -> int:
        """The last seam in (a, mid], else a. Looks back over windows that double."""
        width = self.span
        while True:
            start = max(a, mid - width)
            last = None
            for last in _SEAM.finditer(text, start, min(len(text), mid + 1)):
                pass
            if last is not None and a < last.end() <= mid:
                return last.end()
            if start == a:
                return a
            width *= 2

    def _seam_after(self, text: str, mid: int, b: int) -> int:
        """The first seam in [mid, b), else b."""
        width, start = self.span, max(0, mid - 1)
        while True:
            end = min(b, mid + width)
            found = _SEAM.search(text, start, min(len(text), end + 1))
            if found and mid <= found.end() < b:
                return found.end()
            if end == b:
                return b
            width *= 2

    def _count_back(self, ids: list[int], n: int) -> int:
        size, at = self.size_of, len(ids)
        while n > 0:
            at -= 1
            n -= size[ids[at]]
        return at

    def _count_forward(self, ids: list[int], n: int) -> int:
        size, at = self.size_of, 0
        while n > 0:
            n -= size[ids[at]]
            at += 1
        return at

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        """Bytes of ids; leaves concatenate up the tree."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


_coders: dict[tuple, TreeBPE] = {}


def coder(ranks_path: str, pattern: str, leaf: int, span: int) -> TreeBPE:
    """One coder for each worker process and parameter set."""
    key = (ranks_path, pattern, leaf, span)
    if key not in _coders:
        _coders[key] = TreeBPE(*key)
    return _coders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, leaf: int = 1024, span: int = 64, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """(doc_id, ids array<int>) for every row; null and empty texts have an empty array, repeated rows repeat.

    A map without a shuffle: each executor reads the rank file at ranks_path, which every node has.
    """

    def run(batches):
        c = coder(ranks_path, pattern, leaf, span)
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                ids = [c.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    d = texts(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, content binary) of (doc_id, ids); null ids give empty content."""

    def run(batches):
        c = coder(ranks_path, pattern, 1024, 64)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    d = encoded.select("doc_id", "ids")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, content binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, leaf: int = 1024, span: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): every text encoded, its ids decoded again, both digested.

    One pass: ids live for one document at a time and only the digests leave the worker.
    exact says whether the decoded bytes are the text's. Null and empty texts have no tokens.
    """
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(batches):
        c = coder(ranks_path, pattern, leaf, span)
        names = {i: str(i) for i in c.bytes_of}
        for b in batches:
            n, ids_sha, bytes_sha, exact = [], [], [], []
            for v in b.column(1):
                t = v.as_py() or ""
                ids = c.encode(t)
                back = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(back).hexdigest())
                exact.append(back == t.encode())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip((n, ids_sha, bytes_sha, exact), schema.types))], ["doc_id", *schema.names])

    d = texts(docs, id_col, text_col)
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
