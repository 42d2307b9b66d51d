"""Word and shingle hashes of whole texts, as vector operations on UTF-8 bytes.

Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from talus.llm import worker

U64 = np.uint64
BLOCK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LANE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
worker.remembers("shingles", _powers.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1 modulo 2**64, and their inverses."""
    size = max(BLOCK + 1, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = tuple(out)
    return _powers[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _cut(data: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """Where a block that begins at start may end without dividing a word."""
    end = start + BLOCK
    if end >= len(data):
        return len(data)
    row = offsets[np.searchsorted(offsets, end, "right") - 1]
    spaces = np.flatnonzero(_SPACE[data[max(start, end - 65536) : end]])
    best = max(row, max(start, end - 65536) + spaces[-1] + 1 if len(spaces) else 0)
    while best <= start:
        spaces = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
        nxt = offsets[np.searchsorted(offsets, end, "left")]
        best = min(nxt, end + spaces[0] + 1 if len(spaces) else len(data))
        end += BLOCK
    return int(best)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word in order, where each begins, and for each row which of its words is the first (with the end of the last)."""
    found, places, start = [], [], 0
    while start < len(data):
        end = _cut(data, offsets, start)
        b = data[start:end]
        inside = ~_SPACE[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, end, "left")] - start
        first[rows] = inside[rows]
        at = np.flatnonzero(first)
        if len(at):
            power, inverse = _power(len(b))
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(np.where(inside, _BYTE[b] * power[: len(b)], U64(0)), out=total[1:])
            upto = np.append(at[1:], len(b))
            found.append(mix((total[upto] - total[at]) * inverse[at]))
            places.append(at + start)
        start = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    places = np.concatenate(places)
    return np.concatenate(found), places, np.searchsorted(places, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word in order, and for each row which of its words is the first (with the end of the last)."""
    found, _, bounds = word_places(data, offsets)
    return found, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of width words within a row, and where each row's begin. A shorter row that has words is one shingle."""
    n = np.diff(bounds)
    lane = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        lane += words[k : k + len(lane)] * _LANE[k]
    lane = mix(lane)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    take = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], count)
    short = np.flatnonzero((n > 0) & (n < width))
    take[at[short]] = 0
    out = lane[take] if len(lane) else np.zeros(at[-1], np.uint64)
    for r in short:
        w = words[bounds[r] : bounds[r + 1]]
        out[at[r]] = mix(np.atleast_1d((w * _LANE[width + 1 : width + 1 + len(w)]).sum() + U64(len(w))))[0]
    return out, at


def slices(offsets: np.ndarray, most_bytes: int = 4 << 20, most_rows: int = 4096):
    """Runs of rows (from, to) with at most so many bytes or rows each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1
        hi = max(lo + 1, min(hi, lo + most_rows, n))
        yield lo, hi
        lo = hi
