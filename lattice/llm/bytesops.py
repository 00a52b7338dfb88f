"""NumPy kernels over Arrow string buffers: words, shingles, rolling hashes.

All work on the UTF-8 bytes of whole texts, a few MB at a time, without making
Python strings. Hashes are 64-bit: sums of random byte codes times powers of
an odd number, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = _CODES[LOWER]
CODES = _CODES


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_ODD), run(pow(_ODD, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << 21
    while size < n:
        size <<= 1
    return _powers(size)


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of codes[data[t]] * base**t over i <= t < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent hashes of the byte spans [start, end)."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most`` bytes.

    Yields (first row, end row, bytes, offsets from 0); null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the row of each."""
    space = separators[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hashes(prefix_sums(data, LOWER_CODES if lower else CODES), starts, ends)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items; one for each start, len - k + 1 in all."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(pow(_ODD, 2 * j + 1, 1 << 64))
    return mix(total)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as (values, bounds of the rows).

    A row of 1 to k - 1 words has its whole sequence as its only shingle; one
    without words has none.
    """
    starts, ends, row = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    run = runs(hashed, k)
    out, bounds = [], np.zeros(len(offsets), np.int64)
    for i, n in enumerate(count):
        if n >= k:
            one = np.unique(run[first[i] : first[i] + n - k + 1])
        elif n:
            one = runs(hashed[first[i] : first[i + 1]], int(n)) ^ mix(np.array([n], np.uint64))
        else:
            one = np.zeros(0, np.uint64)
        out.append(one)
        bounds[i + 1] = bounds[i] + len(one)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), bounds


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value of each w consecutive ones (len - w + 1 of them)."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    have = 1
    while have < w:  # doubling: windows of `have` become windows of up to twice that
        step = min(have, w - have)
        m = len(best) - step
        left, right = best[:m], best[step : step + m]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best[:n]
