"""Scoring and its aggregates.

Two shapes of a score table are used: long rows
(member_id, sample_id, class_id, score), and wide rows with one column
s0..s(K-1) per class, where a sum or an arg-max over classes is a plain
expression and a sample costs one row instead of K.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..functions.words import explode_bits, explode_words
from ..names import VOTE_SCALE
from ..session import fits_broadcast
from .by_member import Kernel, bit_matrix, bit_product, by_member, fitted, in_chunks, schema_of, word_matrix
from .learn import CLASSES


def class_columns(classes: list[int] = CLASSES, prefix: str = "s") -> list[str]:
    return [f"{prefix}{k}" for k in classes]


def wide(rows: DataFrame, keys: list[str], value: str, prefix: str = "s", classes: list[int] = CLASSES) -> DataFrame:
    """Long class rows to one column per class."""
    return rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("class_id") == k, F.col(value))).alias(f"{prefix}{k}") for k in classes]
    )


def long(rows: DataFrame, keys: list[str], value: str = "score", prefix: str = "s", classes: list[int] = CLASSES) -> DataFrame:
    pairs = F.arrays_zip(
        const_array(classes).alias("class_id"),
        F.array(*[F.col(f"{prefix}{k}") for k in classes]).alias(value),
    )
    return rows.select(*keys, F.inline(pairs))


def score_wide(features: DataFrame, weights: DataFrame, offsets: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Offset plus the weights of the set bits.

    While the counted model fits a broadcast, a bit meets its K weights as one wide row and sums are combined per sample
    before the exchange; the offset is the weight of one more bit that every sample has. Beyond that, packed rows are
    dealt out in pieces of a member and scored by a matrix product (`by_member`).
    """
    names = class_columns(classes)
    always = offsets.select("member_id", "class_id", F.lit(-1).alias("h"), F.lit(0).alias("v"), F.col("off").alias("w"))
    keys = [c for c in features.columns if c != "words"]
    cells = weights.unionByName(always)
    # a member has one offset row for at least one word of bits
    model_rows = weights.count() // len(classes) * 2
    if not fits_broadcast(features.sparkSession, model_rows, 8 * (len(classes) + 4)):
        schema = schema_of(features, keys, ", ".join(f"{n} bigint" for n in names))
        return by_member(features.where(F.col("words").isNotNull()), cells, score_kernel(keys, classes), schema)
    model = wide(cells, ["member_id", "h", "v"], "w", "s", classes)
    with_one = features.withColumn("words", F.concat(F.array(F.lit(1).cast("bigint")), "words"))
    rows = explode_bits(explode_words(with_one).withColumn("h", F.col("h") - 1))
    hit = rows.join(F.broadcast(model), ["member_id", "h", "v"])
    return hit.groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def score_kernel(keys: list[str], classes: list[int]) -> Kernel:
    names = class_columns(classes)

    def score(rows: pa.Table, cells: pa.Table) -> pa.Table:
        words, _ = word_matrix(rows.column("words"))
        h, v, k, w = (np.asarray(cells.column(c).combine_chunks(), np.int64) for c in ("h", "v", "class_id", "w"))
        column = np.full(int(max(k.max(initial=0), max(classes))) + 1, -1)
        column[classes] = np.arange(len(classes))
        known = column[k] >= 0
        h, v, k, w = h[known], v[known], column[k[known]], w[known]
        offset, matrix = np.zeros(len(classes), np.int64), np.zeros((32 * (int(h.max(initial=-1)) + 1), len(classes)), np.int64)
        np.add.at(offset, k[h < 0], w[h < 0])
        np.add.at(matrix, (32 * h[h >= 0] + v[h >= 0], k[h >= 0]), w[h >= 0])
        if not cells.num_rows:
            rows, words = rows.slice(0, 0), words[:0]
        scores = in_chunks(words, lambda x: bit_product(bit_matrix(fitted(x, len(matrix) // 32)), matrix) + offset, len(classes))
        return pa.table({**{c: rows.column(c) for c in keys}, **{n: scores[:, i] for i, n in enumerate(names)}})

    return score


def score_samples(features: DataFrame, weights: DataFrame, offsets: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    return long(score_wide(features, weights, offsets, classes), ["member_id", "sample_id"], classes=classes)


def best_class(scores: list[Column], classes: list[int] = CLASSES) -> Column:
    """Arg-max over class columns, ties to the lowest class."""
    top = F.greatest(*scores)
    return reduce(lambda acc, ks: F.when(ks[1] == top, F.lit(ks[0])).otherwise(acc),
                  list(zip(classes, scores))[-2::-1], F.lit(classes[-1]))


def best_class_nonzero(scores: list[Column], classes: list[int] = CLASSES) -> Column:
    """Arg-max that skips classes with a total of exactly 0; null if all are 0."""
    kept = [F.when(s != 0, s) for s in scores]
    top = F.greatest(*kept)
    return reduce(lambda acc, ks: F.when(ks[1] == top, F.lit(ks[0])).otherwise(acc),
                  list(zip(classes, kept))[::-1], F.lit(None).cast("int"))


def margin(scores: list[Column]) -> Column:
    """Best minus second best."""
    ordered = F.sort_array(F.array(*scores), asc=False)
    return ordered[0] - ordered[1]


def predictions(scores: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    cols = [F.col(c) for c in class_columns(classes)]
    rest = [c for c in scores.columns if c not in class_columns(classes)]
    return scores.select(*rest, best_class(cols, classes).alias("pred"), margin(cols).alias("margin"))


def ensemble_sum(scores: DataFrame, keys: list[str], classes: list[int] = CLASSES) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in class_columns(classes)])


def votes_normalised(scores: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Scale a member's scores of a sample to a common maximum, truncating."""
    cols = class_columns(classes)
    top = F.greatest(*[F.abs(F.col(c)) for c in cols])
    scaled = scores.withColumn("_m", top)
    # scores stay far below 2^39, so the product fits a BIGINT
    return scaled.select(
        *[c for c in scores.columns if c not in cols],
        *[F.when(F.col("_m") > 0, F.expr(f"({c} * {VOTE_SCALE}L) div _m")).otherwise(F.col(c)).alias(c) for c in cols],
    )


def hit_flag(pred: Column, label: Column, target: list[int] | None = None, binary: bool = False) -> Column:
    """Whether a sample counts as correct under the active evaluation."""
    if target is None:
        ok = pred == label
    elif binary:
        ok = label.isin(target) == pred.isin(target)
    else:
        ok = label.isin(target) & (pred == label)
    return F.coalesce(ok.cast("int"), F.lit(0))


def counted_flag(label: Column, target: list[int] | None = None, binary: bool = False) -> Column:
    """Whether a sample is part of the denominator."""
    if target is None or binary:
        return F.lit(1)
    return label.isin(target).cast("int")


def accuracy(preds: DataFrame, keys: list[str], target: list[int] | None = None, binary: bool = False) -> DataFrame:
    hit = F.sum(hit_flag(F.col("pred"), F.col("label"), target, binary))
    n = F.sum(counted_flag(F.col("label"), target, binary))
    out = preds.groupBy(*keys).agg(hit.alias("correct"), n.alias("n"))
    return out.select(
        *keys, F.col("correct").cast("bigint"), (F.col("n") - F.col("correct")).cast("bigint").alias("errors"),
        F.when(F.col("n") > 0, F.col("correct") * 100.0 / F.col("n")).otherwise(0.0).alias("acc"),
    )


def clarity(scores: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Mean over samples of the spread of a member's class scores."""
    cols = [F.col(c).cast("double") for c in class_columns(classes)]
    k = float(len(cols))
    mean = sum(cols[1:], cols[0]) / k
    spread = scores.withColumn("_mean", mean)
    squares = [(c - F.col("_mean")) * (c - F.col("_mean")) for c in cols]
    return spread.groupBy("member_id").agg(F.avg(F.sqrt(sum(squares[1:], squares[0]) / k)).alias("clarity"))


def member_stats(scores: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Score range, clarity, correct count and accuracy of every member."""
    cols = [F.col(c) for c in class_columns(classes)]
    lows, highs = F.min(F.least(*cols)).alias("min_score"), F.max(F.greatest(*cols)).alias("max_score")
    acc = accuracy(predictions(scores, classes), ["member_id"])
    return scores.groupBy("member_id").agg(lows, highs).join(clarity(scores, classes), "member_id").join(acc, "member_id")


def running_sums(scores: DataFrame, order: list[str], include_current: bool, classes: list[int] = CLASSES, prefix: str = "c") -> DataFrame:
    """Ensemble sums at (or just before) each member, per sample in member order."""
    frame = Window.partitionBy("sample_id").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    return scores.select("*", *[F.coalesce(F.sum(f"s{k}").over(frame), F.lit(0)).alias(f"{prefix}{k}") for k in classes])
