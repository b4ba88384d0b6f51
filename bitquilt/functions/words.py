"""Expressions over 32-bit words kept in BIGINT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import bind, const_array

MASK = 0xFFFFFFFF
GROUP_SIZES = (1, 2, 3, 4, 8, 16, 32)


def pack_array(codes: Column, width: int, n_values: int) -> Column:
    """Pack 32/width neighbouring codes into one word, the first in the low bits."""
    per = 32 // width
    n_words = -(-n_values // per)

    def word(c: Column, h: Column) -> Column:
        parts = [
            F.shiftleft(F.coalesce(F.get(c, h * per + k), F.lit(0).cast("bigint")), k * width)
            for k in range(per)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return bind(codes, lambda c: F.transform(const_array(range(n_words)), lambda h: word(c, h)))


def xnor(a: Column, b: Column) -> Column:
    return F.bitwise_not(a.bitwiseXOR(b)).bitwiseAND(F.lit(MASK))


def popcount_similarity(a: Column, b: Column) -> Column:
    """Number of equal bits of two words."""
    return F.lit(32) - F.bit_count(a.bitwiseXOR(b))


def split_groups(word: Column, group: int) -> Column:
    """One output bit per full group of `group` input bits, set if all are set."""
    if group not in GROUP_SIZES:
        raise ValueError(f"group size {group} not in {GROUP_SIZES}")
    if group == 1:
        return word
    full = (1 << group) - 1
    bits = [
        F.when(F.shiftright(word, g * group).bitwiseAND(F.lit(full)) == full, F.lit(1 << g)).otherwise(F.lit(0))
        for g in range(32 // group)
    ]
    return reduce(lambda a, b: a + b, bits).cast("bigint")


def explode_words(df: DataFrame, words: str = "words") -> DataFrame:
    """One row per word: `h` is its position, `w` its value."""
    rest = [c for c in df.columns if c != words]
    return df.select(*rest, F.posexplode_outer(words).alias("h", "w"))


def explode_bits(df: DataFrame, word: str = "w") -> DataFrame:
    """One row per set bit of `word`, numbered `v`."""
    rest = [c for c in df.columns if c != word]
    return (
        df.where(F.col(word) != 0)
        .select(*rest, word, F.explode(const_array(range(32))).alias("v"))
        .where(F.expr(f"getbit({word}, v) = 1"))
        .select(*rest, "v")
    )


# Upper half of a 64-bit mixing generator. Spark's BIGINT arithmetic checks for
# overflow, so a 64-bit state is carried as two 32-bit halves and multiplied in
# 16-bit limbs. Each step is its own projection, which keeps the plan linear.
# State increment and the two multipliers.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def _low32_product(a: Column, b: int) -> Column:
    lower = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    upper = (F.shiftright(a, 16) * F.lit(b & 0xFFFF)).bitwiseAND(F.lit(0xFFFF))
    return (lower + F.shiftleft(upper, 16)).bitwiseAND(F.lit(MASK))


def _multiply(df: DataFrame, factor: int) -> DataFrame:
    f_lo, f_hi = factor & MASK, factor >> 32
    df = df.withColumns({
        "_p0": F.col("_lo").bitwiseAND(F.lit(0xFFFF)) * F.lit(f_lo),
        "_p1": F.shiftright("_lo", 16) * F.lit(f_lo),
        "_cross": _low32_product(F.col("_lo"), f_hi) + _low32_product(F.col("_hi"), f_lo),
    })
    df = df.withColumn("_sum", F.col("_p0") + F.shiftleft(F.col("_p1").bitwiseAND(F.lit(0xFFFF)), 16))
    return df.withColumns({
        "_lo": F.col("_sum").bitwiseAND(F.lit(MASK)),
        "_hi": (F.shiftright("_p1", 16) + F.shiftright("_sum", 32) + F.col("_cross")).bitwiseAND(F.lit(MASK)),
    })


def _fold(df: DataFrame, shift: int) -> DataFrame:
    carried = F.shiftleft("_hi", 32 - shift).bitwiseAND(F.lit(MASK)).bitwiseOR(F.shiftright("_lo", shift))
    return df.withColumns({
        "_lo": F.col("_lo").bitwiseXOR(carried),
        "_hi": F.col("_hi").bitwiseXOR(F.shiftright("_hi", shift)),
    })


def with_random_word(df: DataFrame, seed: Column, index: Column, out: str = "w") -> DataFrame:
    """Add draw number `index` (from 0) of the generator started at `seed`.

    A draw depends on its seed and number alone, so every row is independent
    and a matrix of any size is produced in parallel without a state.
    """
    columns = df.columns
    step = index.cast("bigint") + 1
    df = df.withColumns({
        "_lo": step.bitwiseAND(F.lit(MASK)),
        "_hi": F.shiftrightunsigned(step, 32),
        "_slo": seed.cast("bigint").bitwiseAND(F.lit(MASK)),
        "_shi": F.shiftrightunsigned(seed.cast("bigint"), 32),
    })
    df = _multiply(df, GAMMA)
    df = df.withColumn("_sum", F.col("_lo") + F.col("_slo"))
    df = df.withColumns({
        "_lo": F.col("_sum").bitwiseAND(F.lit(MASK)),
        "_hi": (F.col("_hi") + F.col("_shi") + F.shiftright("_sum", 32)).bitwiseAND(F.lit(MASK)),
    })
    df = _multiply(_fold(df, 30), MIX_1)
    df = _multiply(_fold(df, 27), MIX_2)
    return df.select(*columns, F.col("_hi").bitwiseXOR(F.shiftright("_hi", 31)).alias(out))


def random_word(seed: int, index: int) -> int:
    """The same draw on the driver, for small constant tables."""
    full = (1 << 64) - 1
    z = (seed + (index + 1) * GAMMA) & full
    z = ((z ^ (z >> 30)) * MIX_1) & full
    z = ((z ^ (z >> 27)) * MIX_2) & full
    return (z ^ (z >> 31)) >> 32
