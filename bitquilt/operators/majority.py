"""Bitwise majority over lists of 32-bit words."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import bind, const_array
from ..functions.words import pack_array
from ..names import MAJORITY_THRESHOLDS

# A BIGINT holds four 16-bit counters (lane set j of 8 counts bits j, j+16, j+8, j+24) or two of 32 bits (set j of 16: j, j+16).
NARROW, WIDE = 8, 16
SLOTS = {NARROW: {0: 0, 16: 16, 32: 8, 48: 24}, WIDE: {0: 0, 32: 16}}
#: Words that the counters of each kind hold.
HOLDS = {NARROW: (1 << 15) - 1, WIDE: (1 << 31) - 1}


def threshold(n: int, mode: str | int = "half") -> int:
    """Count a bit must exceed: an explicit value, half of n, or the tuned table."""
    if isinstance(mode, int):
        return mode
    if mode == "auto":
        return MAJORITY_THRESHOLDS.get(n, n * 135 // 256)
    return n // 2


def threshold_of(n: Column) -> Column:
    """The tuned table for a group size that is only known as a column."""
    tuned = F.lit(None).cast("bigint")
    for size, count in MAJORITY_THRESHOLDS.items():
        tuned = F.when(n == size, F.lit(count).cast("bigint")).otherwise(tuned)
    return F.coalesce(tuned, F.floor(n * 135 / 256))


def _lanes(word: Column, j: int, sets: int) -> Column:
    if sets == WIDE:
        picked = F.shiftright(word, j).bitwiseAND(F.lit(0x00010001))
        return picked.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(F.shiftright(picked, 16), 32))
    picked = F.shiftright(word, j).bitwiseAND(F.lit(0x01010101))
    even, odd = picked.bitwiseAND(F.lit(0x00FF00FF)), F.shiftright(picked, 8).bitwiseAND(F.lit(0x00FF00FF))
    return even.bitwiseOR(F.shiftleft(odd, 32))


def lane_counts(word: Column, sets: int) -> list[Column]:
    """A few sums that together count all 32 bits of the grouped words."""
    return [F.sum(_lanes(word, j, sets)).alias(f"_l{j}") for j in range(sets)]


def word_from_lanes(half: Column | int, sets: int) -> Column:
    bits, full = [], F.lit((1 << (64 // len(SLOTS[sets]))) - 1)
    for j in range(sets):
        for shift, offset in SLOTS[sets].items():
            count = F.shiftrightunsigned(F.col(f"_l{j}"), shift).bitwiseAND(full)
            bits.append(F.when(count > half, F.lit(1 << (j + offset)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, b: a + b, bits)


def majority_exact(rows: DataFrame, keys: list[str], word: str, half: Column | int, out: str = "w", most: int | None = None) -> DataFrame:
    """Bit on if more than `half` of the group's words have it on.

    `half` may use `_n`, the group's number of words. Sixteen partial sums per group replace a row per bit, so the map side
    combines and the shuffle carries one row per group; eight do where a group is known to have at most `most` words and that is small.
    A group may have 2^31 - 1 words; beyond that the sum of a lane leaves BIGINT, which Spark reports.
    """
    if most is not None and most <= HOLDS[NARROW]:
        counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *lane_counts(F.col(word), NARROW))
        return counted.select(*keys, word_from_lanes(half, NARROW).alias(out))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *lane_counts(F.col(word), WIDE))
    return counted.select(*keys, word_from_lanes(half, WIDE).alias(out))


def plane_majority(values: np.ndarray, half: int) -> np.ndarray:
    """Bit on if more than `half` of the values along the first axis have it on.

    Plane k holds the k-th binary digit of the counts of all bits, so a value is
    added by a few bit operations and the counts are compared with `half` at once.
    """
    n = len(values)
    more = np.zeros(values.shape[1:], values.dtype)
    if not 0 <= half < n:
        return ~more if half < 0 else more
    planes = [more] * n.bit_length()
    for i, carry in enumerate(values):
        for k in range((i + 1).bit_length()):
            planes[k], carry = planes[k] ^ carry, planes[k] & carry
    for k, plane in enumerate(planes):
        more = plane & more if half >> k & 1 else plane | more
    return more


def _per_array(words: str, n: int, body: Callable[[np.ndarray], np.ndarray]) -> Column:
    """`body` over the arrays of n words of a batch, given as a matrix with one row per array."""
    @F.arrow_udf("bigint")
    def majority(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().to_numpy(zero_copy_only=False)
        return pa.array(body(flat.astype("<u4").reshape(len(arrays), n)).astype(np.int64))

    return majority(F.col(words))


def _line_majorities(cells: np.ndarray, per_row: int, half: int) -> np.ndarray:
    """One majority per line of `per_row` values along the first axis."""
    return np.stack([plane_majority(cells[i:i + per_row], half) for i in range(0, len(cells), per_row)])


def majority_rowwise(df: DataFrame, words: str, n: int, per_row: int, half: int, out: str = "w") -> DataFrame:
    """Majority inside each grid row of an array of n words, then over the rows, same threshold.

    This and the pixel variants stay inside the row: there are up to as many line results as words, and grouping them
    would hold, or spill, many times the input.
    """
    n_rows = n // per_row if per_row >= 1 else 0
    one_line = n_rows < 2 or n_rows * per_row != n

    def both(matrix: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray(matrix.T)
        return plane_majority(cells if one_line else _line_majorities(cells, per_row, half), half)

    return df.withColumn(out, _per_array(words, n, both))


def _field_cells(matrix: np.ndarray, n: int, width: int) -> np.ndarray:
    """The `width`-bit fields of the n words of every pixel group, as (field, group, array)."""
    groups = 32 // width
    cells = np.ascontiguousarray(matrix.view(f"<u{width // 8}").T)
    return cells.reshape(groups, n * groups, -1 if len(matrix) else 0).swapaxes(0, 1)


def _join_groups(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.T).view("<u4")[:, 0]


def majority_pixel(df: DataFrame, words: str, n: int, width: int, out: str = "w") -> DataFrame:
    """One field majority per pixel group, joined into one word.

    The array holds the n words of each of the 32/width groups, group by group.
    """
    groups = 32 // width
    return df.withColumn(out, _per_array(
        words, n * groups, lambda matrix: _join_groups(plane_majority(_field_cells(matrix, n, width), n * groups // 2))))


def majority_pixel_rowwise(df: DataFrame, words: str, n: int, per_row: int, width: int, out: str = "w") -> DataFrame:
    """The same inside each grid row, then a majority across the rows."""
    per_line = per_row * (32 // width)

    def both(matrix: np.ndarray) -> np.ndarray:
        lines = _line_majorities(_field_cells(matrix, n, width), per_line, per_line // 2)
        return _join_groups(plane_majority(lines, (n // per_row) // 2))

    return df.withColumn(out, _per_array(words, n * (32 // width), both))


def at_least(words: list[Column], need: int) -> Column:
    """Bit on if at least `need` of the words have it on."""
    if need == 1:
        return reduce(lambda a, b: a.bitwiseOR(b), words)
    terms = [reduce(lambda a, b: a.bitwiseAND(b), c) for c in combinations(words, need)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


# Remainder rules of the trees: group size -> how many of it must agree (fixed values).
TREE_RULES = {
    3: {1: 1, 2: 2, 3: 2, 4: 3, 5: 3},
    4: {1: 1, 2: 1, 3: 1, 4: 2},
    5: {1: 1, 2: 2, 3: 3, 4: 4, 5: 4},
    7: {1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5, 7: 5},
}


def tree_level(n: int, base: int) -> list[int]:
    """Group sizes of one level over n values."""
    if base == 3 and n % 3 in (1, 2) and n > 3 + n % 3:
        tail = 3 + n % 3
    elif base == 7 and n % 7 == 1 and n > 7:
        return [7] * (n // 7)  # the last value is left out, which is this tree's rule
    else:
        tail = n % base
    return [base] * ((n - tail) // base) + ([tail] if tail else [])


def majority_tree(df: DataFrame, words: str, n: int, base: int, out: str = "w") -> DataFrame:
    """Tree of small majorities over an array of n words, by position.

    The level count is log(n) and known from n; each level rewrites the array
    inside the row.
    """
    return df.withColumn(out, _tree(F.col(words), n, base)[0])


def _tree(words: Column, n: int, base: int) -> Column:
    if n <= 1:
        return words
    sizes = tree_level(n, base)
    return _tree(bind(words, lambda prev: _reduce_level(prev, sizes, base)), len(sizes), base)


def _reduce_level(prev: Column, sizes: list[int], base: int) -> Column:
    rules, full = TREE_RULES[base], sizes.count(base)
    parts = []
    if full:
        parts.append(F.transform(
            const_array(range(full)), lambda i: at_least([prev[i * base + k] for k in range(base)], rules[base])))
    if len(sizes) > full:
        tail = sizes[-1]
        parts.append(F.array(at_least([prev[full * base + k] for k in range(tail)], rules[tail])))
    return F.concat(*parts)


def majority_tree3_step(df: DataFrame, words: str, n: int, step: int, out: str = "w") -> DataFrame:
    """Tree of 3 over every `step`-th word."""
    picked = list(range(0, n, max(step, 1)))
    stepped = bind(F.col(words), lambda w: F.transform(const_array(picked), lambda i: w[i]))
    return df.withColumn(out, _tree(stepped, len(picked), 3)[0])


def _fields(words: Column, width: int, n: int) -> Column:
    """The width-bit fields of all words, low field first."""
    cuts = range(32 // width)
    full = F.lit((1 << width) - 1)
    return F.flatten(F.transform(words, lambda w: F.array(*[F.shiftright(w, k * width).bitwiseAND(full) for k in cuts])))


def majority_tree3_pixel_step(df: DataFrame, words: str, n: int, step: int, width: int = 8, out: str = "w") -> DataFrame:
    """Tree of 3 whose first triples are `step` fields apart.

    Up to one word apart, a slot of the word is reduced on its own over groups
    of three words with the remainder rules of the tree; further apart, triples
    of fields are packed into words in order and the words are reduced.
    """
    step = max(step, 1)
    body = _far_triples if step > 32 // width else _near_triples
    return df.withColumn(out, bind(_fields(F.col(words), width, n), lambda f: body(f, n, step, width)))


def _far_triples(f: Column, n: int, step: int, width: int) -> Column:
    n_fields = n * (32 // width)
    starts = [i for i in range(0, n_fields, 3 * step) if i + 2 * step < n_fields]
    if not starts:
        return F.lit(0).cast("bigint")
    triples = F.transform(const_array(starts), lambda i: at_least([f[i], f[i + step], f[i + 2 * step]], 2))
    packed = pack_array(triples, width, len(starts))
    return _tree(packed, -(-len(starts) * width // 32), 3)[0]


def _near_triples(f: Column, n: int, step: int, width: int) -> Column:
    per = 32 // width
    sizes = tree_level(n, 3)
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    whole = sizes.count(3)
    slots = []
    for slot in range(per):
        cells, count = [], whole
        if whole:
            starts = const_array([b * per + slot for b in firsts[:whole]])
            cells.append(F.transform(starts, lambda i: at_least([f[i], f[i + step], f[i + 2 * step]], 2)))
        for base, size in zip(firsts[whole:], sizes[whole:]):
            at = base * per + slot
            if size in (4, 5):
                cells.append(F.array(at_least([f[at + k * step] for k in range(size)], 3)))
                count += 1
            else:
                cells.append(F.array(*[f[at + k * per] for k in range(size)]))
                count += size
        slots.append(F.shiftleft(_tree(F.concat(*cells), count, 3)[0], slot * width))
    return reduce(lambda a, b: a.bitwiseOR(b), slots)


def majority_or(rows: DataFrame, keys: list[str], word: str, out: str = "w") -> DataFrame:
    """Pair tree: a bit is on if any word has it on."""
    return rows.groupBy(*keys).agg(F.bit_or(word).alias(out))
