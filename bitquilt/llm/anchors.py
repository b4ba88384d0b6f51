"""Content-defined anchors: positions that equal windows of bytes choose alike."""

from __future__ import annotations

import numpy as np

from .text import mix, powers, seeds

_BYTES = seeds(256, 23) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        _tables["up"] = powers(size, _BASE)
        _tables["down"] = powers(size, pow(_BASE, -1, 1 << 64))
    return _tables["up"], _tables["down"]


class RollingHash:
    """64-bit hashes of any spans of a byte string from one pass over it."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * up[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k bytes, not yet mixed."""
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return (self.sums[k:] - self.sums[:-k]) * self.down[:n]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, RollingHash]:
    """Anchor positions of rows of bytes that stand end to end.

    Each window of `window` bytes inside a row has one anchor: the first of its k-byte grams with the least hash. Equal
    windows have it at the same place, wherever they stand.
    """
    rolling = RollingHash(data)
    n = len(data)
    if n < window:
        return np.empty(0, np.int64), rolling
    grams = mix(rolling.grams(k))
    bits = np.uint64(max(int(n).bit_length(), 1))
    keyed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    least = window_minima(keyed, window - k + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # windows across rows don't count
    inside = np.zeros(n + 1, np.int32)
    usable = np.diff(offsets) >= window
    np.add.at(inside, offsets[:-1][usable], 1)
    np.add.at(inside, offsets[1:][usable] - window + 1, -1)
    at = at[np.cumsum(inside)[:len(at)] > 0]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    at = at[fresh]
    return at, rolling
