"""Words and word n-grams straight from Arrow's UTF-8 buffers, in numpy.

An Arrow string column is one byte buffer with offsets.  All word classes
here keep whole UTF-8 sequences together (every byte >= 0x80 is part of a
word), so words are found, lower-cased (A-Z only) and hashed bytewise, for
a whole batch at once and without one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
FNV_START, FNV_PRIME = U64(0xCBF29CE484222325), U64(0x100000001B3)
#: Bytes of a word that are hashed column by column; the rest of a longer word goes through xxhash.
LONG = 48

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch between documents into runs of about `size` bytes: (first, last, bytes, offsets).

    A longer document is a run by itself: texts are never cut.
    """
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Words:
    """Words of a run of documents.

    low: lower-cased bytes; start, end: of each word; doc_start: index of
    each document's first word (one more entry than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.low = LOWER[data]
        inside = word_bytes[self.low]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(inside))]
        before[cuts], after[cuts - 1] = False, False
        self.start, self.end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.doc_start = np.searchsorted(self.start, offsets)

    def hashes(self, front: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `front` bytes (FNV-1a, mixed)."""
        length = self.end - self.start
        if front is not None:
            length = np.minimum(length, front)
        h = np.full(len(length), FNV_START, U64)
        live = np.arange(len(length))
        for k in range(LONG):
            if not len(live):
                break
            h[live] = (h[live] ^ self.low[self.start[live] + k]) * FNV_PRIME
            live = live[length[live] > k + 1]
        for i in live if front is None else ():
            h[i] ^= U64(xxhash.xxh3_64_intdigest(self.low[self.start[i] + LONG : self.end[i]].tobytes()))
        return mix(h)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions are missing."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    acc = np.full(count, U64(n), U64)
    for j in range(n):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + h[j : j + count])
    return acc


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document; one with fewer words, but not none, has its whole sequence as one."""
    w = Words(data, offsets, NOT_SPACE)
    h = w.hashes()
    g, out = grams(h, n), []
    for a, b in zip(w.doc_start[:-1], w.doc_start[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(grams(h[a:b], int(b - a)) if b > a else np.zeros(0, U64))
    return out
