"""Vectorised word splitting and hashing over Arrow string columns.

A chunk of texts is one byte buffer.  Byte classes mark separators, word
bounds come from neighbouring flags (a text border always ends a word), and
all words are hashed at once from one prefix sum of a polynomial modulo 2^64:
``(P[end] - P[start]) * R^-start`` is the polynomial of the word alone.
Memory is about 40 bytes per byte of a chunk; a chunk holds at least one whole
text, so it is bounded by the larger of ``chunk_bytes`` and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of ASCII: space and 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything of ASCII but digits and lower-case letters (texts are lower-cased first).
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, dtype=_U)
        self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                up = np.full(n, _R, dtype=_U)
                down = np.full(n, _R_INV, dtype=_U)
                up[0] = down[0] = 1
                self.up = np.multiply.accumulate(up)
                self.down = np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int | str, chunk_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``chunk_bytes`` of text, one row at least."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + chunk_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of a chunk: bounds in ``data`` (lower-cased bytes), hashes, and
    the index of the first word of each text (n + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(column: pa.Array, separators: np.ndarray, hashed: bool = True) -> Words:
    raw, offsets = utf8(column)
    data = LOWER[raw]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(separators[data], out=inside[1:-1])
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here & (~before | border))
    end = np.flatnonzero(before & (~here | border))
    first = np.searchsorted(start, offsets)
    if not hashed:
        return Words(data, start, end, np.zeros(0, dtype=_U), first)
    up, down = _POWERS.get(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=prefix[1:])
        value = (prefix[end] - prefix[start]) * down[start]
    return Words(data, start, end, mix64(value), first)
