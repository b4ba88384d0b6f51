"""Reports over an ensemble's score table (wide rows: member, sample, label, s0..)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import explode_words, popcount_similarity
from ..session import fits_broadcast
from .by_member import Kernel, bit_matrix, bit_product, by_member, fitted, in_chunks, schema_of, word_matrix
from .learn import CLASSES, bits
from .rank import global_rank
from .score import (
    accuracy, best_class, class_columns, ensemble_sum, hit_flag, long, margin, predictions, running_sums, wide,
)


def pairs(scores: DataFrame) -> DataFrame:
    """Every member's class and decision margin for every sample."""
    p = predictions(scores)
    return p.select("member_id", "sample_id", F.col("pred").cast("int"), "margin")


def accuracy_curve(scores: DataFrame, order: list[str]) -> DataFrame:
    """Ensemble accuracy after each member in the order, with the gain to the step before.

    `order` are member columns of `scores`; running sums are per sample, so the
    window partitions are as many as the samples.
    """
    sums = running_sums(scores, order, True)
    cols = [F.col(c) for c in class_columns(prefix="c")]
    keys = list(dict.fromkeys(["member_id", *order]))
    flagged = sums.select(*keys, "label", best_class(cols).alias("pred"))
    return flagged.groupBy(*keys).agg(
        F.sum(hit_flag(F.col("pred"), F.col("label"))).cast("bigint").alias("correct"), F.count("*").alias("total"))


def with_curve_steps(per_member: DataFrame, order: list[str]) -> DataFrame:
    """Number the curve points and add accuracy and gain (one row per member)."""
    ranked = global_rank(per_member, [F.col(c) for c in order], "_i")
    ranked = ranked.withColumn("en", (F.col("_i") + 1).cast("bigint")).withColumn(
        "acc", F.col("correct") * 100.0 / F.col("total"))
    before = ranked.select((F.col("en") + 1).alias("en"), F.col("acc").alias("_prev"))
    joined = ranked.join(before, "en", "left")
    return joined.select("en", "member_id", "correct", "total", "acc",
                         (F.col("acc") - F.coalesce(F.col("_prev"), F.lit(0.0))).alias("gain"))


def best_prefix(curve: DataFrame) -> DataFrame:
    """First maximum of the curve."""
    return curve.agg(F.max_by(F.struct("en", "correct", "acc"), F.struct("correct", -F.col("en"))).alias("_b")).select(
        F.col("_b.en").alias("best_en"), F.col("_b.correct").alias("correct"), F.col("_b.acc").alias("acc"))


def agreement(scores: DataFrame, order: list[str]) -> DataFrame:
    """Member right while the ensemble before it was wrong, and the reverse."""
    sums = running_sums(scores, order, False)
    ens = best_class([F.col(c) for c in class_columns(prefix="c")])
    own = best_class([F.col(c) for c in class_columns()])
    flagged = sums.select("member_id", (own == F.col("label")).alias("own"), (ens == F.col("label")).alias("ens"))
    return flagged.groupBy("member_id").agg(
        F.count_if(F.col("own") & ~F.col("ens")).alias("agree"),
        F.count_if(~F.col("own") & F.col("ens")).alias("disagree"))


def confusion(preds: DataFrame) -> DataFrame:
    """Row-normalised confusion in percent with the row's error percent, classes that occur only."""
    cells = preds.groupBy("label", "pred").agg(F.count("*").alias("n"))
    rows = preds.groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("pred") == F.col("label")).alias("ok"))
    return cells.join(rows, "label").select(
        "label", "pred", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"),
        ((F.col("total") - F.col("ok")) * 100.0 / F.col("total")).alias("err_pct"))


def class_recall(scores: DataFrame) -> DataFrame:
    """Recall of every member and of the ensemble (member_id -1) by class, with the member's average."""
    single = predictions(scores).select("member_id", "label", "pred")
    total = predictions(ensemble_sum(scores, ["sample_id", "label"])).select(
        F.lit(-1).cast("bigint").alias("member_id"), "label", "pred")
    both = single.unionByName(total)
    recall = both.groupBy("member_id", "label").agg(
        F.count_if(F.col("pred") == F.col("label")).alias("correct"), F.count("*").alias("n"))
    recall = recall.withColumn("recall", F.col("correct") * 100.0 / F.col("n"))
    mean = Window.partitionBy("member_id")  # at most one row per class
    return recall.withColumn("avg_recall", F.avg("recall").over(mean))


def weight_extremes(weights: DataFrame) -> DataFrame:
    """Smallest and largest weight of every member with its first position."""
    low = F.min(F.struct("w", "class_id", "h", "v")).alias("lo")
    high = F.min(F.struct((-F.col("w")).alias("nw"), F.col("class_id"), F.col("h"), F.col("v"))).alias("hi")
    agg = weights.groupBy("member_id").agg(low, high)
    return agg.select(
        "member_id", F.col("lo.w").alias("min_w"), F.col("lo.class_id").alias("min_class"), F.col("lo.h").alias("min_h"),
        F.col("lo.v").alias("min_v"), (-F.col("hi.nw")).alias("max_w"), F.col("hi.class_id").alias("max_class"),
        F.col("hi.h").alias("max_h"), F.col("hi.v").alias("max_v"))


def score_checksum(scores: DataFrame) -> DataFrame:
    """Order-free checksum of every member's scores."""
    digest = F.xxhash64("sample_id", *class_columns())
    return scores.groupBy("member_id").agg(F.bit_xor(digest).alias("checksum"), F.count("*").alias("n"))


def report(train: DataFrame, evals: DataFrame, members: int, penalty: float = 0.02) -> DataFrame:
    """One row: train %, eval %, errors, members and eval less a charge per extra member."""
    def pct(preds: DataFrame):
        return preds.agg(F.count_if(F.col("pred") == F.col("label")) * 100.0 / F.count("*")).scalar()

    errors = evals.agg(F.count_if(F.col("pred") != F.col("label")).alias("errors"))
    row = errors.select(pct(train).alias("train_pct"), pct(evals).alias("eval_pct"), "errors")
    return row.select("train_pct", "eval_pct", "errors", F.lit(members).cast("bigint").alias("members"),
                      (F.col("eval_pct") - penalty * (members - 1)).alias("eff"))


def errors_by_class(preds: DataFrame) -> DataFrame:
    """Misclassified samples, to be read by true class."""
    return preds.where("pred <> label").select("label", "sample_id", "pred")


# --- prototypes -------------------------------------------------------------

def prototypes(features: DataFrame, percent: int, classes: list[int] = CLASSES) -> DataFrame:
    """Word per (member, class, h): a bit is on if more than the class's threshold have it."""
    train = features.where("split = 'train'")
    sizes = train.groupBy("member_id").agg(*[F.count_if(F.col("label") == k).alias(f"n{k}") for k in classes])
    counts = bits(train.select("member_id", "label", "words")).groupBy("member_id", "h", "v").agg(
        *[F.count_if(F.col("label") == k).alias(f"t{k}") for k in classes])
    joined = counts.join(sizes, "member_id")

    def word(k: int):
        limit = F.greatest(F.expr(f"(n{k} * {percent} + 50) div 100"), F.lit(1))
        return F.sum(F.when(F.col(f"t{k}") > limit, F.expr("shiftleft(1L, v)")).otherwise(F.lit(0).cast("bigint")))

    agg = joined.groupBy("member_id", "h").agg(*[word(k).alias(f"s{k}") for k in classes])
    return long(agg, ["member_id", "h"], "w", classes=classes).select("member_id", "class_id", "h", "w")


def prototype_scores(features: DataFrame, protos: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Equal bits between a sample's words and each class prototype, wide by class; a missing prototype word is 0.

    Prototypes that do not fit a broadcast meet packed rows in pieces of a member (`by_member`).
    """
    given = features.select("member_id", "sample_id", "split", "label", "words")
    keys, names = ["member_id", "sample_id", "split", "label"], class_columns(classes)
    p_rows = protos.count() // len(classes)
    if not fits_broadcast(features.sparkSession, p_rows, 8 * (len(classes) + 3)):
        schema = schema_of(given, keys, ", ".join(f"{n} bigint" for n in names))
        return by_member(given.where(F.size("words") > 0), protos, prototype_kernel(keys, classes), schema)
    p = wide(protos, ["member_id", "h"], "w", "p", classes)
    sims = [F.sum(popcount_similarity(F.col("w"), F.coalesce(F.col(f"p{k}"), F.lit(0).cast("bigint"))).cast("bigint")).alias(f"s{k}") for k in classes]
    joined = explode_words(given).join(F.broadcast(p), ["member_id", "h"], "left")
    return joined.groupBy(*keys).agg(*sims)


def prototype_kernel(keys: list[str], classes: list[int]) -> Kernel:
    names = class_columns(classes)

    def score(rows: pa.Table, protos: pa.Table) -> pa.Table:
        words, sizes = word_matrix(rows.column("words"))
        h, k, w = (np.asarray(protos.column(c).combine_chunks(), np.int64) for c in ("h", "class_id", "w"))
        proto = np.zeros((len(classes), max(words.shape[1], int(h.max(initial=-1)) + 1)), "<u4")
        for i, label in enumerate(classes):
            proto[i, h[k == label]] = w[k == label]
        on = bit_matrix(proto).astype(np.int64).T
        total = np.concatenate([np.zeros((1, len(classes)), np.int64), on.cumsum(axis=0)])

        def equal(part: np.ndarray) -> np.ndarray:
            bits = bit_matrix(fitted(part, proto.shape[1]))
            return 2 * bit_product(bits, on) - bits.sum(axis=1, dtype=np.int64)[:, None]

        # equal bits of a row: 2 x.p - |x| - |p| + bits, all within its own words
        scores = in_chunks(words, equal, len(classes)) - total[32 * sizes] + 32 * sizes[:, None]
        return pa.table({**{c: rows.column(c) for c in keys}, **{n: scores[:, i] for i, n in enumerate(names)}})

    return score


def prototype_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bits that differ between two prototype sets."""
    a, b = old.withColumnRenamed("w", "_a"), new.withColumnRenamed("w", "_b")
    zero = F.lit(0).cast("bigint")
    diff = F.bit_count(F.coalesce("_a", zero).bitwiseXOR(F.coalesce("_b", zero))).cast("bigint")
    return a.join(b, ["member_id", "class_id", "h"], "full").groupBy("member_id").agg(F.sum(diff).alias("flips"))


def set_table(scores: DataFrame, order: list[str], target: list[int]) -> DataFrame:
    """Cumulative target accuracy, accuracy and errors in addition order."""
    sums = running_sums(scores, order, True)
    flagged = sums.select("member_id", "label", best_class([F.col(c) for c in class_columns(prefix="c")]).alias("pred"))
    full = accuracy(flagged, ["member_id"])
    aimed = accuracy(flagged, ["member_id"], target).select(
        "member_id", F.col("correct").alias("target_correct"), F.col("acc").alias("target_acc"))
    return full.join(aimed, "member_id")


def sample_margins(scores: DataFrame) -> DataFrame:
    return scores.select("member_id", "sample_id", margin([F.col(c) for c in class_columns()]).alias("margin"))
