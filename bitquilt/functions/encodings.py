"""Thermometer encodings of a byte.

A byte has 256 values, so an encoding is a 256-entry constant array that is
built once per plan and looked up inside the task's generated code.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..names import ENCODINGS
from .constants import const_array


def _piecewise(v: int, m: int, knee: int, share: int, top: int, strict: bool) -> int:
    below = v <= knee if strict else v < knee
    if below:
        return v * share // knee
    return share + (v - knee) * (m - share) // top


def _mid(v: int, m: int) -> int:
    share = m * 3 // 8
    if v < 80:
        return v * share // 80
    if v > 175:
        return share + (v - 175) * (m - share) // 80
    return share + (v - 80) * (m - share) // 95


def _scaled(unit: float, m: int) -> int:
    return int(unit * m + 0.5)


_LEVELS = {
    "lin7": lambda v, m: v >> 5,
    "lin": lambda v, m: v * m >> 8,
    "down": lambda v, m: _piecewise(v, m, 64, m * 3 // 7, 192, False),
    "up": lambda v, m: _piecewise(v, m, 192, m * 4 // 7, 63, True),
    "mid": _mid,
    "log": lambda v, m: _scaled(math.log2(v + 1) / 8.0, m),
    "exp": lambda v, m: _scaled((v / 255.0) ** (0.35 if m == 16 else 0.30), m),
    "sig": lambda v, m: _scaled(1.0 / (1.0 + math.exp(-12.0 * (v / 255.0 - 0.5))), m),
    "sqrt": lambda v, m: _scaled(math.sqrt(v / 255.0), m),
    "cbrt": lambda v, m: _scaled((v / 255.0) ** (1.0 / 3.0), m),
    "gamma": lambda v, m: _scaled((v / 255.0) ** 0.45, m),
    "tri": lambda v, m: min(v, 255 - v) * m * 2 // 255,
    "inv-exp": lambda v, m: _scaled(1.0 - math.exp(-4.0 * v / 255.0), m),
}


def thermometer(level: int) -> int:
    """The lowest `level` bits set, saturating at a 32-bit word."""
    return (1 << max(0, min(level, 32))) - 1


@lru_cache(maxsize=None)
def code_table(encoding: str, width: int = 8) -> tuple[int, ...]:
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    if encoding == "raw":
        return tuple(range(256))
    level = _LEVELS[encoding]
    return tuple(thermometer(level(v, width)) for v in range(256))


def _table_column(encoding: str, width: int) -> Column:
    return const_array(code_table(encoding, width), "bigint")


def encode(value: Column, encoding: str, width: int = 8) -> Column:
    """Code of one byte column."""
    return _table_column(encoding, width)[value]


def encode_array(px: Column, encoding: str, width: int = 8) -> Column:
    """Code of every byte of a grid held in one array."""
    table = _table_column(encoding, width)
    return F.transform(px, lambda v: table[v])
