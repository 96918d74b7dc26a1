"""Words of many texts at once as 64-bit hashes, in numpy over the texts' bytes.

A word is a run of bytes other than ASCII white space (blank and 0x09-0x0D). Its hash is a polynomial over
random values of its bytes, modulo 2**64, that is mixed; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.random.Generator(np.random.PCG64(20240101))
_VALUE = _R.integers(1, 1 << 63, size=256, dtype=np.uint64)
_BASE = int(_R.integers(1 << 40, 1 << 62)) * 2 + 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPAN = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SPAN)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, dtype=np.uint64))) for x in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows) of at most ``most`` bytes, or of one row.

    Null counts as empty.
    """
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column):
        return
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, data[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each row (and in all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    # A word ends at the next blank, or where the next row begins.
    stop = ~inside
    stop[edges] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """One hash for each word; ``fold`` lower-cases A-Z. Works on about a MB at a time."""
    out, lo = np.empty(len(starts), dtype=np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _SPAN, side="right")))
        a = int(starts[lo])
        part = data[a: int(ends[hi - 1])]
        if fold:
            part = _FOLD[part]
        power, inverse = _powers(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * power, out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s])
        lo = hi
    return out


_STEP = np.uint64(0x9E3779B97F4A7C15)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; one for each start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + h[i: i + n]
    return mix(out)
