"""Learning by counting: class counts, bit counts, log-odds, offsets.

Features are rows (member_id, sample_id, split, label, words ARRAY<BIGINT>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..functions.words import explode_bits, explode_words, with_random_word
from ..names import ODDS_SCALE
from ..session import cut

CLASSES = list(range(10))
MODES = ("count", "random", "inverse", "uniform", "prior", "laplace", "dampen")


def fixed_point(x: Column) -> Column:
    return F.round(x * float(ODDS_SCALE)).cast("bigint")


def bits(features: DataFrame) -> DataFrame:
    """One row per set bit of a feature vector."""
    return explode_bits(explode_words(features))


def class_counts(features: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """n_k of every member, with a row for classes that have no sample."""
    wide = features.groupBy("member_id").agg(
        F.array(*[F.count_if(F.col("label") == k) for k in classes]).alias("_n")
    )
    pairs = F.arrays_zip(const_array(classes).alias("class_id"), F.col("_n").alias("n_k"))
    return wide.select("member_id", F.inline(pairs))


def hit_counts(train: DataFrame, n_bits: int = 32, classes: list[int] = CLASSES) -> DataFrame:
    """t(member, class, h, v) over the full grid, zero counts included.

    One row per set bit goes into a partial aggregate with one conditional
    count per class, so a class that holds most rows adds no skew; the grid of
    bits comes from the distinct (member, h) of the features.
    """
    counted = bits(train.select("member_id", "label", "words")).groupBy("member_id", "h", "v").agg(
        *[F.count_if(F.col("label") == k).alias(f"_t{k}") for k in classes]
    )
    grid = (
        train.groupBy("member_id").agg(F.max(F.size("words")).alias("_n"))
        .select("member_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("h"))
        .withColumn("v", F.explode(const_array(range(n_bits))))
    )
    full = grid.join(counted, ["member_id", "h", "v"], "left")
    pairs = F.arrays_zip(
        const_array(classes).alias("class_id"),
        F.array(*[F.coalesce(F.col(f"_t{k}"), F.lit(0)) for k in classes]).alias("t"),
    )
    return full.select("member_id", "h", "v", F.inline(pairs))


def initial_target(hits: DataFrame, counts: DataFrame, mode: str, seed: int = 42, n_bits: int = 32, n_words: int = 16) -> DataFrame:
    """Starting counts of a target table from the hit counts."""
    rows = hits.join(counts, ["member_id", "class_id"])
    t, n = F.col("t"), F.col("n_k")
    if mode == "random":
        index = (F.col("class_id") * n_words + F.col("h")) * n_bits + F.col("v")
        rows = with_random_word(rows, F.col("member_id") + seed, index, "_w")
        value = F.when(n > 0, F.col("_w") % (n + 1)).otherwise(0)
    else:
        value = {
            "count": t, "inverse": t,
            "uniform": F.lit(1),
            "prior": n,
            "laplace": F.when(t < n, t + 1).otherwise(t),
            "dampen": F.shiftright(t, 1),
        }[mode]
    return rows.select("member_id", "class_id", "h", "v", value.cast("bigint").alias("t"), "n_k")


def log_odds(target: DataFrame, inverse: bool = False) -> DataFrame:
    """w = ln(p / (1-p)), p = (t+1)/(n+2); classes without samples keep their count."""
    p = (F.col("t") + 1) / (F.col("n_k") + 2)
    w = fixed_point(F.log(p / (1 - p)))
    w = F.when(F.col("n_k") > 0, -w if inverse else w).otherwise(F.col("t"))
    return target.select("member_id", "class_id", "h", "v", w.alias("w"))


def class_offset(target: DataFrame) -> DataFrame:
    """Sum of ln((n-t+1)/(n+2)) over all bits, rounded once."""
    p0 = F.log((F.col("n_k") - F.col("t") + 1) / (F.col("n_k") + 2))
    total = F.sum(F.when(F.col("n_k") > 0, p0).otherwise(0.0))
    return target.groupBy("member_id", "class_id").agg(fixed_point(total).alias("off"))


def fit(features: DataFrame, mode: str = "count", n_bits: int = 32, classes: list[int] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """Weights (member_id, class_id, h, v, w) and offsets (member_id, class_id, off).

    The counts are model-sized and written once, so the training bits are
    passed over a single time for both results.
    """
    train = features.where("split = 'train'")
    target = cut(initial_target(hit_counts(train, n_bits, classes), class_counts(train, classes), mode), "target")
    return log_odds(target, mode == "inverse"), class_offset(target)
