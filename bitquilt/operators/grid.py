"""Grid reshaping on samples that hold their grid in one array column.

Every reshaping step is a constant index map, so a sample is rewritten inside
its row: no row explosion and no shuffle, whatever the number of samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import bind, const_array
from ..functions.words import random_word

# rotation steps of 22.5 degrees (fixed values)
ROTATIONS = {
    "rot22": 22.5, "rot45": 45.0, "rot67": 67.5, "rot112": 112.5, "rot135": 135.0, "rot157": 157.5,
    "rot202": 202.5, "rot225": 225.0, "rot247": 247.5, "rot292": 292.5, "rot315": 315.0, "rot337": 337.5,
}


@dataclass(frozen=True)
class Shape:
    width: int
    height: int
    planes: int = 1

    @property
    def size(self) -> int:
        return self.width * self.height


def _rotation(name: str, s: Shape) -> list[int]:
    f = np.float32
    rad = f(ROTATIONS[name]) * f(math.pi) / f(180)
    c, sn = f(math.cos(float(rad))), f(math.sin(float(rad)))
    cx, cy = f(s.width - 1) * f(0.5), f(s.height - 1) * f(0.5)
    y, x = np.mgrid[0 : s.height, 0 : s.width].astype(np.float32)
    sx = c * (x - cx) + sn * (y - cy) + cx
    sy = -sn * (x - cx) + c * (y - cy) + cy
    ix, iy = np.trunc(sx + f(0.5)).astype(int), np.trunc(sy + f(0.5)).astype(int)
    inside = (ix >= 0) & (ix < s.width) & (iy >= 0) & (iy < s.height)
    return np.where(inside, iy * s.width + ix, -1).ravel().tolist()


def shuffle_order(seed: int, size: int) -> list[int]:
    """Seeded permutation: positions in the order of their random word."""
    return sorted(range(size), key=lambda p: (random_word(seed, p), p))


def _column_swap(near: int, x: int, width: int) -> int:
    gap = 4 - near
    if x % 4 == near and x + gap < width:
        return x + gap
    if x % 4 == 0 and x > 0:
        return x - gap
    return x


def move_map(name: str, s: Shape) -> list[int] | None:
    """Source position of every destination of one plane, -1 for "filled with 0".

    None if the step is not a pure move.
    """
    w, h = s.width, s.height
    square = {
        "dflip1": lambda y, x: (x, y),
        "dflip2": lambda y, x: (w - 1 - x, h - 1 - y),
        "rot90": lambda y, x: (h - 1 - x, y),
        "rot270": lambda y, x: (x, h - 1 - y),
    }
    plain = {
        "id": lambda y, x: (y, x),
        "rot0": lambda y, x: (y, x),
        "hflip": lambda y, x: (y, w - 1 - x),
        "vflip": lambda y, x: (h - 1 - y, x),
        "colswap-3-4": lambda y, x: (y, _column_swap(3, x, w)),
        "colswap-2-4": lambda y, x: (y, _column_swap(2, x, w)),
        "colswap-1-4": lambda y, x: (y, _column_swap(1, x, w)),
    }
    if name in ROTATIONS:
        return _rotation(name, s)
    if name.startswith("shuffle"):
        return shuffle_order(int(name[7:] or 42), s.size)
    if name.startswith("sft-"):
        n = int(name[5:])
        dy, dx = {"u": (n, 0), "d": (-n, 0), "l": (0, n), "r": (0, -n)}[name[4]]
        rule = lambda y, x: (y + dy, x + dx)
    elif name in square:
        if w != h:
            raise ValueError(f"{name} needs a square grid")
        rule = square[name]
    elif name in plain:
        rule = plain[name]
    elif name in ("avg2", "avg3", "avg4", "spiral"):
        return None
    else:
        raise ValueError(f"unknown xform {name!r}")
    sources = []
    for y in range(h):
        for x in range(w):
            sy, sx = rule(y, x)
            sources.append(sy * w + sx if 0 <= sy < h and 0 <= sx < w else -1)
    return sources


def compose(first: list[int], then: list[int]) -> list[int]:
    """One map for two pure moves applied in turn."""
    return [first[i] if i >= 0 else -1 for i in then]


def _over_planes(one_plane: list[int], s: Shape) -> list[int]:
    return [p * s.size + i if i >= 0 else -1 for p in range(s.planes) for i in one_plane]


def _move(px: Column, sources: list[int]) -> Column:
    return F.transform(
        const_array(sources),
        lambda i: F.when(i >= 0, F.get(px, F.greatest(i, F.lit(0)))).otherwise(F.lit(0)).cast("int"),
    )


def _running_mean(px: Column, taps: int, s: Shape) -> Column:
    neighbours = []
    for k in range(taps):
        one = [y * s.width + (x + k) % s.width for y in range(s.height) for x in range(s.width)]
        neighbours.append(_over_planes(one, s))
    rows = const_array(list(zip(*neighbours)))

    def mean(idx: Column) -> Column:
        total = px[idx[0]]
        for k in range(1, taps):
            total = total + px[idx[k]]
        return F.floor(total / taps).cast("int")

    return F.transform(rows, mean)


def spiral_map(s: Shape) -> list[list[float]]:
    """Per destination: top-left source (-1 if outside) and four bilinear weights."""
    f = np.float32
    cx, cy = f(s.width) * f(0.5) - f(0.5), f(s.height) * f(0.5) - f(0.5)
    reach = min(f(s.width), f(s.height)) * f(0.5) * f(0.7)
    out = []
    for p in range(s.planes):
        ox = f(p - 1) * f(0.3) if s.planes >= 3 else f(0)
        oy = f(p - 1) * f(-0.3) if s.planes >= 3 else f(0)
        for y in range(s.height):
            for x in range(s.width):
                dx, dy = f(x) - cx, f(y) - cy
                r = f(math.sqrt(float(dx * dx + dy * dy)))
                turn = f(math.atan2(float(dy), float(dx))) + f(8) * f(math.exp(float(-r / reach)))
                sx = cx + r * f(math.cos(float(turn))) + ox
                sy = cy + r * f(math.sin(float(turn))) + oy
                ix, iy = int(sx), int(sy)
                if 0 <= ix < s.width - 1 and 0 <= iy < s.height - 1:
                    fx, fy = float(sx - f(ix)), float(sy - f(iy))
                    out.append([float(p * s.size + iy * s.width + ix),
                                (1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy])
                else:
                    out.append([-1.0, 0.0, 0.0, 0.0, 0.0])
    return out


def _spiral(px: Column, s: Shape) -> Column:
    def blend(m: Column) -> Column:
        i = m[0].cast("int")
        total = px[i] * m[1] + px[i + 1] * m[2] + px[i + s.width] * m[3] + px[i + s.width + 1] * m[4]
        # nine digits settle ties whatever the order of the sum
        value = F.least(F.greatest(F.floor(F.round(total, 9) + 0.5), F.lit(0)), F.lit(255))
        return F.when(i < 0, F.lit(128)).otherwise(value).cast("int")

    return F.transform(const_array(spiral_map(s)), blend)


def apply_xform(px: Column, spec: str, s: Shape) -> Column:
    """Apply a chain such as `rot22@avg4`, left to right.

    Neighbouring pure moves are merged into one map before touching the data.
    """
    pending: list[int] | None = None
    for step in spec.split("@"):
        if step in ("id", "rot0"):
            continue
        moves = move_map(step, s)
        if moves is not None:
            pending = moves if pending is None else compose(pending, moves)
            continue
        if pending is not None:
            px, pending = _moved(px, pending, s), None
        px = _blended(px, step, s)
    return px if pending is None else _moved(px, pending, s)


def _moved(px: Column, one_plane: list[int], s: Shape) -> Column:
    sources = _over_planes(one_plane, s)
    return bind(px, lambda p: _move(p, sources))


def _blended(px: Column, step: str, s: Shape) -> Column:
    if step == "spiral":
        return bind(px, lambda p: _spiral(p, s))
    return bind(px, lambda p: _running_mean(p, int(step[3:]), s))
