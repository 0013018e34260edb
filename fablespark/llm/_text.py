"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is seen as one UTF-8 byte array with document offsets. Words are
maximal runs of bytes other than space and 0x09-0x0D; as those are ASCII, byte and
code-point splitting agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _tables(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64), seed) | _U(1)


_TABLE = {seed: _tables(seed) for seed in (11, 12)}
_MULT = {11: 0x9E3779B97F4A7C15, 12: 0xC2B2AE3D27D4EB4F}
_POW: dict[int, np.ndarray] = {}


def powers(seed: int, n: int) -> np.ndarray:
    """At least n powers of the seed's odd multiplier, modulo 2**64."""
    if seed not in _POW or len(_POW[seed]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POW[seed] = np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, _MULT[seed], np.uint64)])
    return _POW[seed]


def column_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, pa.scalar("", arr.type) if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(arr) + 1, arr.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` text bytes, so that temporary arrays stay small."""
    if not batch.num_rows:
        return
    _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts: byte starts and ends, offsets by document, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = buf = LOWER[buf] if lower else buf
        self.off = off
        n = len(buf)
        ink = ~SPACE[buf]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        first[inner] = ink[inner]
        last[inner - 1] = ink[inner - 1]
        self.ink = ink
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc_off = np.searchsorted(self.start, off)
        self.n = len(self.start)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.doc_off))

    def hashes(self, seed: int = 11) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not self.n:
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.flatnonzero(self.ink)
        head = np.zeros(self.n, np.int64)
        np.cumsum(size[:-1], out=head[1:])
        pos = np.arange(len(at)) - np.repeat(head, size)
        with np.errstate(over="ignore"):
            part = _TABLE[seed][self.buf[at]] * powers(seed, int(size.max()))[pos]
            return mix64(np.add.reduceat(part, head) + size.astype(np.uint64), seed)

    def windows(self, hashes: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
        """(start word index, hash) of every k-word window inside one document."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(m, np.uint64)
            mult = powers(seed, k)
            for j in range(k):
                total += hashes[j : j + m] * mult[j]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return at, mix64(total[at], seed)


def count_by_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true entries in each [off[i], off[i+1])."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean array of length n, true in every [start, start + width)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1) if len(starts) < 64 else edge.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    ends = np.minimum(starts + width, n)
    edge -= np.bincount(ends, minlength=n + 1).astype(np.int32) if len(ends) else 0
    return np.cumsum(edge[:-1]) > 0
