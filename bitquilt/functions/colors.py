"""Point colour channels derived from the r, g and b planes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import bind, const_array


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def _mean(a: Column, b: Column) -> Column:
    return F.shiftright(a + b, 1)


def _luma(r: Column, g: Column, b: Column, weights: tuple[int, int, int]) -> Column:
    return F.shiftright(r * weights[0] + g * weights[1] + b * weights[2], 8)


def hue(r: Column, g: Column, b: Column) -> Column:
    turn = F.atan2((g - b).cast("double"), (r * 2 - g - b).cast("double")) / (2.0 * math.pi)
    return clamp(((turn + 0.5) * 255.0).cast("int"))


def color_channel(name: str, r: Column, g: Column, b: Column) -> Column:
    formulas = {
        "R": lambda: r,
        "G": lambda: g,
        "B": lambda: b,
        "Y": lambda: _luma(r, g, b, (77, 150, 29)),
        "YL": lambda: _luma(r, g, b, (54, 183, 18)),
        "AL": lambda: _mean(r, g),
        "BL": lambda: _mean(r, b),
        "CL": lambda: _mean(g, b),
        "AM": lambda: clamp(r - g + 128),
        "BM": lambda: clamp(r - b + 128),
        "CM": lambda: clamp(g - b + 128),
        "RG": lambda: clamp(r - g + 128),
        "RB": lambda: clamp(r - b + 128),
        "GB": lambda: clamp(g - b + 128),
        "AP": lambda: clamp(b - _mean(r, g) + 128),
        "BP": lambda: clamp(g - _mean(r, b) + 128),
        "CP": lambda: clamp(r - _mean(g, b) + 128),
        "H": lambda: hue(r, g, b),
        "S": lambda: F.greatest(r, g, b) - F.least(r, g, b),
    }
    return formulas[name]().cast("int")


POINT_CHANNELS = ["R", "G", "B", "Y", "YL", "AL", "BL", "CL", "AM", "BM", "CM",
                  "RG", "RB", "GB", "AP", "BP", "CP", "S"]


def channel_array(name: str, px: Column, plane_size: int) -> Column:
    """A derived channel of a three-plane grid as one array."""

    def cells(p: Column) -> Column:
        return F.transform(
            const_array(range(plane_size)),
            lambda i: color_channel(name, p[i], p[i + plane_size], p[i + 2 * plane_size]),
        )

    return bind(px, cells)
