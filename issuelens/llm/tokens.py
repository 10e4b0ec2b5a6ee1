"""Words and word hashes of whole Arrow text columns, vectorised.

A word is a maximal run of bytes of one class; a document's end always ends
a word.  All work is on whole-buffer numpy arrays, so a task spends a few
nanoseconds per byte and never loops over words in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from issuelens.functions.memory import give_back  # noqa: F401

#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_SPACE
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
#: Base of the Rabin-Karp polynomial over word hashes (odd, so invertible modulo 2**64).
BASE = np.uint64(0xD1342543DE82EF95)
_CHUNKS = 32  # words longer than 8 * this many bytes are finished by a digest
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive documents: byte spans, hashes, and where each document's words begin."""

    data: np.ndarray    # uint8, the (lower-cased) bytes of all documents
    start: np.ndarray   # int64 per word, into data
    end: np.ndarray
    hash: np.ndarray    # uint64 per word
    first: np.ndarray   # int64 per document + 1, into the words
    at: np.ndarray      # int64 per document + 1, byte offsets into data

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together; a longer one alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE,
          lower: bool = False, hashes: bool = True) -> Words:
    """Words of the documents that ``offsets`` cuts out of ``data``."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    first = np.searchsorted(start, offsets).astype(np.int64)
    h = word_hashes(data, start, end) if hashes else np.zeros(0, np.uint64)
    return Words(data, start, end, h, first, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, eight bytes at a time."""
    size = end - start
    h = size.astype(np.uint64) * _M1
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    live = np.arange(len(start))
    for k in range(_CHUNKS):
        left = size[live] - 8 * k
        value = eight[start[live] + 8 * k] & _TAIL[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ value) * _M1)
        live = live[left > 8]
        if not len(live):
            return h
    for i in live:
        rest = hashlib.blake2b(data[start[i] + 8 * _CHUNKS:end[i]].tobytes(), digest_size=8).digest()
        h[i] ^= np.frombuffer(rest, np.uint64)[0]
    return h


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and Rabin-Karp hash of each window of ``size`` consecutive words of one document."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = w.hash[:n - size + 1].copy()
    for k in range(1, size):
        rolling *= BASE
        rolling += w.hash[k:n - size + 1 + k]
    doc = w.doc_of()
    at = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:])
    return at, mix(rolling[at])


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, bytes, offsets)`` of runs of documents of a batch."""
    data, off = buffers(col)
    for lo, hi in slices(off, limit):
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
