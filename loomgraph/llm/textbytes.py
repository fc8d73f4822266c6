"""Vectorised work on UTF-8 text as Arrow holds it: words, hashes and chunks, with no loop per character."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

def _give_back() -> None:
    """Workers outlive their tasks, so what a task frees should leave the process: Arrow's own allocator keeps it, the system's
    keeps it below thresholds that grow with use. They are fixed here: M_TRIM_THRESHOLD (-1) and M_MMAP_THRESHOLD (-3)."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:  # glibc
        mallopt(-1, 8 << 20)
        mallopt(-3, 2 << 20)


_give_back()

#: Bytes of text worked on at once; work arrays take about 60 times as much.
CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20250101))
#: A random odd base and one random value for each byte.
_BASE = np.uint64(_rng.integers(1, 1 << 63) * 2 + 1)
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_pow: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if int(base) not in _pow or len(_pow[int(base)]) < n:
        a = np.full(max(n, CHUNK + 4096), base, np.uint64)
        a[0] = 1
        _pow[int(base)] = np.cumprod(a, dtype=np.uint64)
    return _pow[int(base)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of runs of rows; a longer text is a run alone."""
    offsets, data = utf8(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash sums of all prefixes; see :func:`span_hashes`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    return mix((prefix[end] - prefix[start]) * powers(_INV, len(prefix))[start] + (end - start).astype(np.uint64))


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every run of bytes that are no white space (0x20, 0x09 to 0x0D); A-Z count as a-z if ``lower``."""
    if lower:
        data = _LOWER[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    inside = cut[solid[1:-1][cut]]
    starts[inside] = True
    before = cut[solid[1:-1][cut - 1]] - 1
    ends[before] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, span_hashes(prefix_hashes(data), start, end)


def shingles(row: np.ndarray, word: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a row with 1 to k - 1 words has its whole sequence as one."""
    c = np.uint64(0x9E3779B97F4A7C15)
    n = len(word) - k + 1
    if n > 0:
        h = word[:n].copy()
        for i in range(1, k):
            h = h * c + word[i : i + n]
        whole = row[:n] == row[k - 1 :]
        out_row, out = row[:n][whole], mix(h[whole])
    else:
        out_row, out = row[:0], word[:0]
    count = np.bincount(row, minlength=rows)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(row, few)
        h = np.full(len(few), 0, np.uint64)
        for i in range(k - 1):
            has = count[few] > i
            h[has] = h[has] * c + word[first[has] + i]
        h = mix(h + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out_row, out = np.concatenate([out_row, few]), np.concatenate([out, h])
        order = np.argsort(out_row, kind="stable")
        out_row, out = out_row[order], out[order]
    return out_row, out


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted; ``row`` must be sorted."""
    if not len(row):
        return row, h
    edges = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
    h = h.copy()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        h[lo:hi].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The buckets that occur, and each column's values in them as bytes; columns may be stacked rows of values."""
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    edge = np.append(first, len(order))
    return there, [[np.ascontiguousarray(c[..., order[a:b]]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)] for c in columns]
