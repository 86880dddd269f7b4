"""Vectorised word hashing over Arrow string columns.

Every word-based operator of this subpackage sees a text as the byte string of
its UTF-8 form.  The bytes 0x09-0x0D and 0x20 occur in UTF-8 only as those
characters, so words ``[^\\x20\\x09-\\x0D]+`` can be found on bytes.  A word's
64-bit hash is a polynomial over its bytes, taken from running sums, so that a
whole chunk of texts is hashed by a handful of numpy calls.

Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_P, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of texts: row r has the words first[r]:first[r + 1]."""

    row0: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are made empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def word_chunks(column: pa.Array, lower: bool) -> Iterator[Words]:
    """Hashed words of a column, in runs of whole rows of about CHUNK_BYTES bytes.

    A text longer than that is a run of its own.
    """
    if not len(column):
        return
    raw, at = string_buffers(column)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield _words(raw, at, row, stop, lower)
        row = stop


def _words(raw: np.ndarray, at: np.ndarray, row: int, stop: int, lower: bool) -> Words:
    data = raw[at[row] : at[stop]]
    if lower:
        data = _LOWER[data]
    n = len(data)
    edges = at[row : stop + 1] - at[row]
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        cut = edges[1:-1]  # a text's start and end also bound its words
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = solid[cut]
        ends[cut - 1] = solid[cut - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    p, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * inverse[starts])
    return Words(row, data, hashes, starts, stops, np.searchsorted(starts, edges))


def run_hashes(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; len(hashes) - k + 1 of them."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    b = base | 1
    p = np.full(len(hashes), np.uint64(b), np.uint64)
    p[0] = 1
    p = np.multiply.accumulate(p)
    q = np.full(len(hashes) - k + 1, np.uint64(pow(b, -1, 1 << 64)), np.uint64)
    q[0] = 1
    q = np.multiply.accumulate(q)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * p, out=total[1:])
    return mix((total[k:] - total[:-k]) * q)


def planes(values: np.ndarray) -> bytes:
    """A number array as byte planes, lowest first: small numbers leave planes of zeros, which a block compressor removes."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    flat = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(flat.reshape(d.itemsize, -1).T).view(d).reshape(-1)


def crc32_text(numbers) -> list[int]:
    """Unsigned crc32 of each number's decimal form."""
    import zlib

    return [zlib.crc32(b"" if v is None else str(v).encode()) for v in numbers]
