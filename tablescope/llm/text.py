"""Vectorised word and shingle hashing over Arrow text columns.

The helpers turn a whole Arrow batch into numpy arrays at once: word boundaries come from a
256-entry byte table, a word hash is a weighted byte sum (``np.add.reduceat``) that is mixed
afterwards, and a shingle hash combines the hashes of neighbouring words. There is no Python
loop over words or documents. Texts are processed in groups of bounded byte size, so memory
follows the largest single text, not the batch.

Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

GROUP_BYTES = 2_000_000      # texts handled together; one longer text is a group of its own
HASH_BYTES = 1_000_000       # bytes hashed at once inside a group

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)

# Separators of the two word rules. Bytes from 0x80 up belong to words in both,
# so a rule on UTF-8 bytes equals the rule on characters.
_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
SPACE_WORDS = _SPACE                                   # [^\x20\x09-\x0D]+
_ALNUM = np.ones(256, dtype=bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _ALNUM[_lo:_hi + 1] = False
ALNUM_WORDS = _ALNUM                                   # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=_U)
    out[0] = _U(1)
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def _power_table(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(2 * n)
    return _POWERS


@dataclass
class Words:
    """Words of a group of texts: byte span, index of the text in the group, 64-bit hash."""

    first: int               # index of the group's first text in the batch
    n_docs: int
    data: np.ndarray         # bytes of the group (lower-cased if asked)
    offsets: np.ndarray      # n_docs + 1 byte offsets into data
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """n_docs + 1 word indices: the words of text i are bounds[i]:bounds[i + 1]."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=_U)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, shingle_hash(self.hash, at, k)


def shingle_hash(word_hash: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each index in ``at``; depends on the words and their order."""
    out = np.zeros(len(at), dtype=_U)
    p = _power_table(k + 1)
    for j in range(k):
        out += word_hash[at + j] * p[j + 1]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or not pa.types.is_string(column.type):
        column = pa.compute.fill_null(column.cast(pa.string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(n + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.empty(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return offsets, raw


def byte_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive texts of at most ``limit`` bytes together (or one longer text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def iter_words(column: pa.Array, table: np.ndarray = SPACE_WORDS, fold: np.ndarray | None = None,
               limit: int = GROUP_BYTES) -> Iterator[Words]:
    """The words of an Arrow text column, group by group; every text is in exactly one group."""
    offsets, raw = text_buffers(column)
    for i, j in byte_groups(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        data = raw[lo:hi]
        if fold is not None:
            data = fold[data]
        off = offsets[i:j + 1] - lo
        inside = table[data]
        n = len(data)
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = off[1:-1][off[1:-1] < n]
            before[edge] = False
            after[edge[edge > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(off, start, side="right") - 1
        yield Words(i, j - i, data, off, start, end, doc, _hash_words(data, inside, start, end))


def _hash_words(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=_U)
    size = end - start
    cum = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(start):
        j = int(np.searchsorted(cum, cum[i] + HASH_BYTES, side="right")) - 1
        j = max(j, i + 1)
        lo, hi = start[i], end[j - 1]
        body = data[lo:hi][inside[lo:hi]].astype(_U) + _U(1)
        at = cum[i:j] - cum[i]
        rel = np.arange(len(body)) - np.repeat(at, size[i:j])
        body *= _power_table(int(rel.max()) + 1)[rel]
        out[i:j] = np.add.reduceat(body, at)
        i = j
    return mix(out ^ (size.astype(_U) * _U(0xD6E8FEB86659FD93)))


def hash_of_words(text: str, table: np.ndarray = SPACE_WORDS, fold: np.ndarray | None = None) -> np.ndarray:
    """Word hashes of one text (for small reference sets and tests)."""
    return np.concatenate([w.hash for w in iter_words(pa.array([text or ""]), table, fold)] or
                          [np.empty(0, dtype=_U)])
