"""Neighbourhood channels of a one-plane grid held in an array column.

A border cell takes the value of the nearest cell that has all neighbours, so
each destination is evaluated at a constant "centre" position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import channel_array
from ..functions.constants import bind, const_array
from ..names import GRAY_CHANNELS
from .grid import Shape

AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def _centres(s: Shape, margin: int) -> Column:
    if s.width <= 2 * margin or s.height <= 2 * margin:
        raise ValueError("grid is smaller than the stencil")

    def inner(i: int, n: int) -> int:
        return min(max(i, margin), n - 1 - margin)

    return const_array([inner(y, s.height) * s.width + inner(x, s.width)
                        for y in range(s.height) for x in range(s.width)])


def _patch(px: Column, c: Column, s: Shape, radius: int) -> list[Column]:
    span = range(-radius, radius + 1)
    return [px[c + (dy * s.width + dx)] for dy in span for dx in span]


def _total(cells: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cells)


def _div(a: Column, n: int) -> Column:
    """Integer division of a value that is not negative."""
    return F.floor(a / n).cast("int")


def _gradients(px: Column, c: Column, s: Shape) -> tuple[Column, Column]:
    def at(dy: int, dx: int) -> Column:
        return px[c + (dy * s.width + dx)]

    gx = at(-1, 1) - at(-1, -1) + (at(0, 1) - at(0, -1)) * 2 + at(1, 1) - at(1, -1)
    gy = at(1, -1) - at(-1, -1) + (at(1, 0) - at(-1, 0)) * 2 + at(1, 1) - at(-1, 1)
    return gx, gy


def sobel(px: Column, s: Shape, divisor: float) -> Column:
    def magnitude(g: Column) -> Column:
        size = F.sqrt((g["x"] * g["x"] + g["y"] * g["y"]).cast("double")) / divisor
        return F.least(F.floor(size + 0.5), F.lit(255)).cast("int")

    return F.transform(_gradient_pairs(px, s), magnitude)


def _gradient_pairs(px: Column, s: Shape) -> Column:
    def pair(c: Column) -> Column:
        gx, gy = _gradients(px, c, s)
        return F.struct(gx.alias("x"), gy.alias("y"))

    return F.transform(_centres(s, 1), pair)


def direction(px: Column, s: Shape) -> Column:
    def sector(g: Column) -> Column:
        x, y = g["x"], g["y"]
        flat, steep = F.abs(x) > F.abs(y) * 2, F.abs(y) > F.abs(x) * 2
        right, up = x >= 0, y >= 0
        straight = F.when(right, 0).otherwise(4)
        upright = F.when(up, 2).otherwise(6)
        slanted = F.when(right & up, 1).when(up, 3).when(~right, 5).otherwise(7)
        return F.when((x == 0) & (y == 0), 0).when(flat, straight).when(steep, upright).otherwise(slanted) * 32

    return F.transform(_gradient_pairs(px, s), sector)


def local_binary_pattern(px: Column, s: Shape) -> Column:
    def code(c: Column) -> Column:
        return _total([
            F.when(px[c + (dy * s.width + dx)] >= px[c], 0x80 >> k).otherwise(0)
            for k, (dy, dx) in enumerate(AROUND)
        ])

    return F.transform(_centres(s, 1), code)


def difference_of_means(px: Column, s: Shape) -> Column:
    def value(c: Column) -> Column:
        near, far = _div(_total(_patch(px, c, s, 1)), 9), _div(_total(_patch(px, c, s, 2)), 25)
        return F.least(F.greatest(near - far + 128, F.lit(0)), F.lit(255)).cast("int")

    return F.transform(_centres(s, 2), value)


def mean_deviation(px: Column, s: Shape) -> Column:
    def with_mean(c: Column) -> Column:
        return F.struct(c.alias("c"), _div(_total(_patch(px, c, s, 1)), 9).alias("m"))

    def value(e: Column) -> Column:
        return _div(_total([F.abs(p - e["m"]) for p in _patch(px, e["c"], s, 1)]), 9)

    return F.transform(F.transform(_centres(s, 1), with_mean), value)


def local_range(px: Column, s: Shape) -> Column:
    def value(c: Column) -> Column:
        cells = _patch(px, c, s, 1)
        return F.greatest(*cells) - F.least(*cells)

    return F.transform(_centres(s, 1), value)


def two_level(px: Column, s: Shape) -> Column:
    """0 or 255 per cell, split at the threshold with the largest between-class variance.

    One pass over the sorted values of the sample carries the count, the sum
    and the best threshold so far (first maximum, 128 if there is none).
    """
    n = s.size

    def scan(ordered: Column, total: Column) -> Column:
        entries = F.transform(ordered, lambda v, i: F.struct(v.alias("v"), F.get(ordered, i + 1).alias("next")))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(0.0).alias("best"), F.lit(128).alias("t"))

        def step(acc: Column, e: Column) -> Column:
            count, below = acc["n"] + 1, acc["s"] + e["v"]
            rest = F.greatest(F.lit(n) - count, F.lit(1))
            gap = below / count - (total - below) / rest
            spread = count.cast("double") * rest * gap * gap
            better = (e["next"] != e["v"]) & (spread > acc["best"])
            return F.struct(count.alias("n"), below.alias("s"), F.when(better, spread).otherwise(acc["best"]).alias("best"),
                            F.when(better, e["v"]).otherwise(acc["t"]).alias("t"))

        return F.aggregate(entries, start, step, lambda acc: acc["t"])

    def with_total(ordered: Column) -> Column:
        return bind(F.aggregate(ordered, F.lit(0), lambda a, v: a + v), lambda total: scan(ordered, total))

    limit = bind(F.array_sort(px), with_total)
    return bind(limit, lambda t: F.transform(px, lambda v: F.when(v > t, F.lit(255)).otherwise(F.lit(0))))


STENCILS = {
    "bin": two_level,
    "edge": lambda px, s: sobel(px, s, 6.0),
    "C": lambda px, s: sobel(px, s, 4.0),
    "lbp": local_binary_pattern,
    "dog": difference_of_means,
    "var": mean_deviation,
    "dir": direction,
    "range": local_range,
}

# channel read by a neighbourhood channel when the grid has three planes (fixed values)
STENCIL_SOURCE = {"edge": "Y", "bin": "Y", "lbp": "Y", "dog": "Y", "var": "Y", "dir": "Y", "range": "Y", "C": "AL",
                  "lbp-rg": "RG", "lbp-rb": "RB", "lbp-gb": "GB"}


def with_channel(df: DataFrame, channel: str, s: Shape, px: str = "px", out: str = "px") -> DataFrame:
    """Replace or add a grid by one of its derived channels."""
    base = "lbp" if channel.startswith("lbp") else channel
    source = F.col(px)
    if s.planes == 3:
        source = channel_array(STENCIL_SOURCE.get(channel, channel), source, s.size)
    elif channel not in GRAY_CHANNELS:
        raise ValueError(f"channel {channel!r} needs three planes")
    if base in STENCILS:
        source = bind(source, lambda p: STENCILS[base](p, s))
    return df.withColumn(out, source)
