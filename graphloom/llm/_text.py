"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes that Arrow already holds: no Python string is made per row.  A
*chunk* is a run of consecutive rows of about ``CHUNK`` bytes, so that the numpy temporaries stay in cache
and memory does not depend on the batch.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + (1 << 18))
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Cumulative polynomial hash, one longer than ``data``."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]``, independent of where it stands."""
    _, q = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


@dataclass
class Chunk:
    """Rows ``first .. first + len(offsets) - 1`` of a batch; ``offsets`` are relative to ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offs, body = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Chunk(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Word spans of a chunk; ``row`` is the row of each word, ``bounds`` the first word of each row and the end."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def words(chunk: Chunk, extra_space: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not ASCII white space, cut at row ends."""
    gap = (SPACE if extra_space is None else extra_space)[chunk.data]
    n = len(gap)
    if not n:
        return Words(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(chunk.rows + 1, np.int64))
    head = chunk.offsets[:-1]
    head = head[head < n]
    begin = ~gap
    begin[1:] &= gap[:-1]
    begin[head] = ~gap[head]
    finish = ~gap
    finish[:-1] &= gap[1:]
    last = head[head > 0] - 1
    finish[last] = ~gap[last]
    finish[-1] = not gap[-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    bounds = np.searchsorted(start, chunk.offsets)
    return Words(start, end, np.repeat(np.arange(chunk.rows), np.diff(bounds)), bounds)


def word_hashes(chunk: Chunk, w: Words, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_hash(LOWER[chunk.data] if lower else chunk.data), w.start, w.end)


def shingles(hashes: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``k``-word shingles as (hash, row, first word); a row of fewer words gives its whole sequence as one."""
    n = len(hashes)
    counts = np.diff(w.bounds)
    size = np.minimum(np.repeat(counts, counts), k)
    first = np.flatnonzero(np.arange(n) + size <= np.repeat(w.bounds[1:], counts)) if n else np.zeros(0, np.int64)
    p, q = powers(n)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * p[:n], out=total[1:])
        h = (total[first + size[first]] - total[first]) * q[first]
        return mix(h + size[first].astype(np.uint64)), w.row[first], first


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
