"""Vectorised text primitives shared by the Arrow-side operators.

A batch of texts is handled as one UTF-8 byte buffer with document offsets,
cut into chunks of bounded size, so memory does not follow the batch size.
Hashes are polynomial sums modulo 2**64, which makes the hash of any byte
range two lookups, followed by a finalising mix.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_B = 0xC2B2AE3D27D4EB4F
_B_INV = pow(_B, -1, 1 << 64)
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Gives freed memory back to the system where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Task) -> Task:
    """The same task; at its end freed memory goes back, as workers live on and wait between stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: their Python objects take as much again as the batch."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            m = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
            for name, base in (("up", _B), ("down", _B_INV)):
                x = np.full(m, base, U64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (for numbers much faster than by a hash table)."""
    x = np.sort(x)
    if len(x) > 1:
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return x


class Chunk:
    """Documents ``lo..hi`` of a batch: ``data`` bytes and ``offs`` offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.lo, self.hi, self.data, self.offs = lo, hi, data, offs

    def lowered(self) -> "Chunk":
        return Chunk(self.lo, self.hi, _LOWER[self.data], self.offs)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (from 0 in the chunk) of each word.

        Words are maximal runs of bytes other than space and 0x09-0x0D;
        they never cross documents.
        """
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        inside = ~_SPACE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = self.offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        doc = np.searchsorted(self.offs, starts, side="right") - 1
        return starts, ends, doc

    def prefix(self) -> np.ndarray:
        """Prefix sums from which :func:`span_hash` hashes any byte range."""
        up, _ = _Powers.upto(len(self.data))
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``starts..ends`` of one chunk."""
    _, down = _Powers.upto(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string array into chunks of whole documents of about ``limit`` bytes.

    A document longer than the limit is a chunk of its own; nulls are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, off, body = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each ``k``-word shingle, in text order.

    A document with one to ``k - 1`` words has its whole sequence as its only
    shingle; a document without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    parts_h, parts_d = [], []
    m = len(words) - k + 1
    if m > 0:
        same = doc[:m] == doc[k - 1 :]
        h = np.zeros(m, U64)
        for j in range(k):
            h = mix(h * U64(0x9E3779B97F4A7C15) + words[j : m + j])
        parts_h.append(h[same])
        parts_d.append(doc[:m][same])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = np.full(len(short), 0x1234567, U64)
        for j in range(k - 1):
            more = counts[short] > j
            at = np.minimum(first[short] + j, max(len(words) - 1, 0))
            h = np.where(more, mix(h * U64(0x9E3779B97F4A7C15) + words[at] + U64(j + 1)), h)
        parts_h.append(h)
        parts_d.append(short)
    if not parts_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    if len(short) and m > 0:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def distinct_pairs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document) pairs, sorted by document, then by hash."""
    if not len(h):
        return h, doc
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]
