"""Vectorised text helpers for tasks that get Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; bounds memory, never cuts a text.
CHUNK_BYTES = 1 << 20
#: The word separators: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=np.uint64) + np.uint64(1 + salt * 1_000_003)) * np.uint64(_ODD))


def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * step
            step = step * step
            done += more
    return out[:n]


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, row starts and row ends of a string or binary column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    starts, ends = offsets[:-1], offsets[1:]
    if column.null_count:
        ends = np.where(np.asarray(column.is_valid()), ends, starts)
    return data, starts, ends


def spans_of(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, or one row."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


def packed_rows(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes of these rows end to end, row offsets into them)."""
    data, starts, ends = byte_rows(column)
    sizes = ends - starts
    for a, b in spans_of(sizes, limit):
        offsets = np.concatenate([[0], np.cumsum(sizes[a:b])])
        if (starts[a + 1:b] == ends[a:b - 1]).all():
            yield a, b, data[starts[a]:ends[b - 1]], offsets
        else:
            yield a, b, np.concatenate([data[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)]), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, A-Z lower-cased, and word offsets by row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.empty(0, np.uint64), bounds
    where = np.flatnonzero(inside)
    word = np.cumsum(first)[where] - 1
    within = where - at[word]
    with np.errstate(over="ignore"):
        part = _BYTE[data[where]] * powers(int(within.max()) + 1)[within]
        sums = np.add.reduceat(part, np.flatnonzero(first[where]))
    return mix(sums), bounds


_BYTE = seeds(256, 7)[LOWER] | np.uint64(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their offsets; a row of 1 to k-1 words has one, of them all."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not out_bounds[-1]:
        return np.empty(0, np.uint64), out_bounds
    row = np.repeat(np.arange(len(counts)), sizes)
    start = bounds[:-1][row] + np.arange(out_bounds[-1]) - out_bounds[:-1][row]
    length = np.minimum(counts, k)[row]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    weights = seeds(k + 1, 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = length.astype(np.uint64) * weights[k]
        for i in range(k):
            total = mix(total ^ np.where(i < length, padded[start + i] * weights[i], np.uint64(0)))
    return total, out_bounds
