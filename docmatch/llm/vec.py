"""Vectorised text kernels shared by the corpus operators.

All kernels work on the UTF-8 buffer of an Arrow string array, many documents at a
time, so no Python code runs per word. A word is a maximal run of bytes outside
``\\x20\\x09-\\x0D``; since those are ASCII, byte and code-point views agree on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
#: Longer texts are looked at in pieces.
PIECE_BYTES = 8 << 20
#: Words of more bytes are hashed by BLAKE2.
MAX_POLY = 200

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INV)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one longer document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def pieces(data: np.ndarray, overlap: int, limit: int | None = None) -> Iterator[tuple[int, int, int]]:
    """A long text in pieces (start, end, where the next one starts) of about ``limit``
    bytes that end at white space; the next one begins with the last ``overlap`` words of
    the one before, so windows of ``overlap`` + 1 words are each in one piece whole. Kernels
    take some sixty bytes for each of the text, so a text isn't given to them at once."""
    n, start, size = len(data), 0, limit or PIECE_BYTES
    while True:
        end = start + size
        if end >= n:
            yield start, n, n
            return
        space = IS_SPACE[data[start:end]]
        solid = ~space
        solid[1:] &= space[:-1]
        words = np.flatnonzero(solid)
        if not space.any() or len(words) < overlap + 2:
            size *= 2  # few words, as they are long
            continue
        end -= int(space[::-1].argmax())
        words = words[words < end - start]
        if len(words) < overlap + 2:
            size *= 2
            continue
        yield start, end, start + int(words[-overlap])
        start, size = start + int(words[-overlap]), limit or PIECE_BYTES


class Words:
    """Words of a run of documents: ``start``, ``end`` (byte positions), ``doc``, and
    ``hash`` (64 bits of the word's bytes, equal for equal words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        n = len(data)
        space = IS_SPACE[data]
        solid = ~space
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = solid.copy()
        first[1:] &= space[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= space[1:] | edge[1:n]
        self.solid = solid
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.prefix = prefix_hash(LOWER[data] if lower else data)
        self.hash = self.range_hash(self.start, self.end)
        # powers modulo 2 ** 64 let some long texts of two signs collide whatever the base
        for i in np.flatnonzero(self.end - self.start > MAX_POLY).tolist():
            word = data[self.start[i] : self.end[i]]
            self.hash[i] = int.from_bytes(hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power_tables(len(self.data) + 1)[1]
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start])

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over each document's bytes of a 0/1 array over bytes."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start indices of the windows of ``size`` words inside one document, and
        their hashes."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        h = self.hash[:n].copy()
        for k in range(1, size):
            h = mix(h * U64(0xD6E8FEB86659FD93) + self.hash[k : n + k])
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, h[at]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = a hash of data[i:j] times BASE ** i."""
    out = np.zeros(len(data) + 1, U64)
    power = _power_tables(len(data) + 1)[0]
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=out[1:])
    return out


def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item, its number of equal items (same doc, same hash), itself included."""
    if not len(h):
        return np.zeros(0, np.int64)
    _, at, count = np.unique(mix(h + (doc.astype(U64) + U64(1)) * BASE), return_inverse=True, return_counts=True)
    return count[at]
