"""Iterative training: one or two jobs per pass, all members in the same job.

The state between passes is a table in the shared folder, so plans do not
grow and a lost executor does not replay earlier passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..names import ODDS_BITS, ODDS_SCALE
from ..session import cut, discard
from .learn import CLASSES, bits, fit
from .reports import prototype_flips, prototype_scores, prototypes
from .score import class_columns, predictions, score_wide


@dataclass
class TrainResult:
    weights: DataFrame
    offsets: DataFrame
    history: list[dict] = field(default_factory=list)


def pass_errors(scored: DataFrame, step: Column | int, use_gap: bool = True, classes: list[int] = CLASSES) -> DataFrame:
    """Misclassified training rows with their correction step.

    Below one unit of the fixed-point scale the step shrinks with the gap
    between the predicted and the true class, but not under 1.
    """
    label_score = F.coalesce(*[F.when(F.col("label") == k, F.col(f"s{k}")) for k in classes])
    top = F.greatest(*[F.col(c) for c in class_columns(classes)])
    flagged = predictions(scored.withColumns({"_own": label_score, "_top": top}), classes)
    wrong = flagged.where("pred <> label").withColumn("_gap", F.col("_top") - F.col("_own"))
    size = F.lit(step).cast("bigint") if isinstance(step, int) else step.cast("bigint")
    if use_gap:
        wrong = wrong.where("_gap > 0")
        scaled = F.greatest(F.shiftright(size * F.col("_gap"), ODDS_BITS), F.lit(1).cast("bigint"))
        size = F.when(F.col("_gap") < ODDS_SCALE, scaled).otherwise(size)
    return wrong.select("member_id", "sample_id", "label", "pred", size.alias("step"))


def corrections(errors: DataFrame, features: DataFrame) -> DataFrame:
    """Summed change of every weight: up for the true class, down for the predicted one."""
    words = features.select("member_id", "sample_id", "words")
    hit = bits(words.join(errors, ["member_id", "sample_id"]))
    both = F.array(
        F.struct(F.col("label").cast("int").alias("class_id"), F.col("step").alias("d")),
        F.struct(F.col("pred").cast("int").alias("class_id"), (-F.col("step")).alias("d")),
    )
    rows = hit.select("member_id", "h", "v", F.inline(both))
    return rows.groupBy("member_id", "class_id", "h", "v").agg(F.sum("d").alias("delta"))


def apply_corrections(weights: DataFrame, deltas: DataFrame) -> DataFrame:
    joined = weights.join(deltas, ["member_id", "class_id", "h", "v"], "left")
    return joined.select("member_id", "class_id", "h", "v", (F.col("w") + F.coalesce("delta", F.lit(0))).cast("bigint").alias("w"))


def correct_pass(features: DataFrame, weights: DataFrame, offsets: DataFrame, step: Column | int, use_gap: bool = True) -> DataFrame:
    """One whole-set error correction pass; `features` holds the training rows."""
    scored = score_wide(features, weights, offsets)
    return apply_corrections(weights, corrections(pass_errors(scored, step, use_gap), features))


def step_at(epoch: int, epochs: int, first: int, warmup: int = 0, lr_min: float = 0.0, gap_k: float = 0.0, gap: float = 0.0) -> int:
    """Warm-up, then a cosine from 1 to lr_min, damped by the generalisation gap; at least 2."""
    if warmup > 0 and epoch < warmup:
        step = int(first * (epoch + 1) / warmup + 0.5)
    else:
        progress = min((epoch - warmup) / max(epochs - warmup, 1), 1.0)
        step = int(first * (lr_min + (1.0 - lr_min) * (1.0 + math.cos(math.pi * progress)) / 2.0) + 0.5)
    if gap_k > 0.0 and gap > 0.0:
        step = int(step * math.exp(-gap_k * gap) + 0.5)
    return max(step, 2)


def error_rates(scored: DataFrame) -> DataFrame:
    """(member_id, split, errors, n) of a score table."""
    return predictions(scored).groupBy("member_id", "split").agg(
        F.count_if(F.col("pred") != F.col("label")).alias("errors"), F.count("*").alias("n"))


def _rates(scored: DataFrame) -> dict[int, dict[str, tuple[int, int]]]:
    # one row per member and split: catalogue-sized
    out: dict[int, dict[str, tuple[int, int]]] = {}
    for r in error_rates(scored).collect():
        out.setdefault(r["member_id"], {})[r["split"]] = (r["errors"], r["n"])
    return out


def _gap(rates: dict[str, tuple[int, int]]) -> float:
    (te, tn), (ee, en) = rates.get("train", (0, 1)), rates.get("eval", (0, 1))
    return max(ee / max(en, 1) - te / max(tn, 1), 0.0)


def _per_member(values: dict[int, int]) -> Column:
    pairs = [F.lit(x).cast("bigint") for kv in values.items() for x in kv]
    return F.create_map(*pairs)[F.col("member_id")]


def _mixed(members: list[int], of_these: DataFrame, of_others: DataFrame, name: str) -> DataFrame:
    chosen = F.col("member_id").isin(members)
    return cut(of_these.where(chosen).unionByName(of_others.where(~chosen)), name)


def train_correct(
    features: DataFrame, epochs: int, first_step: int = ODDS_SCALE // 8, *, warmup: int = 0, lr_min: float = 0.0,
    gap_k: float = 0.0, use_gap: bool = True, rollback: bool = False, mode: str = "count",
) -> TrainResult:
    """Counting, then `epochs` correction passes.

    With rollback a member whose training errors rise goes back to its best
    weights and retries with two thirds of its step, at most five times.

    The features are placed by (member, sample) once for all epochs, so neither
    scoring nor correcting moves them again; an epoch scores them once, and
    that score table gives both its error rates and the next corrections.
    """
    placed = features.repartition("member_id", "sample_id").persist()
    try:
        weights, offsets = fit(placed, mode)
        weights, offsets = cut(weights, "weights"), cut(offsets, "offsets")
        scored = cut(score_wide(placed, weights, offsets), "scored")
        rates = _rates(scored)
        firsts, tries, epoch = dict.fromkeys(rates, first_step), dict.fromkeys(rates, 0), dict.fromkeys(rates, 0)
        best = {m: r["train"][0] for m, r in rates.items()}
        best_state = (weights, scored)
        history = []
        while active := [m for m, e in epoch.items() if e < epochs]:
            steps = {m: step_at(epoch[m], epochs, firsts[m], warmup, lr_min, gap_k, _gap(rates[m])) for m in active}
            live = scored.where((F.col("split") == "train") & F.col("member_id").isin(active))
            deltas = corrections(pass_errors(live, _per_member(steps), use_gap), placed)
            before = (weights, scored)
            weights = cut(apply_corrections(weights, deltas), "weights")
            scored = cut(score_wide(placed, weights, offsets), "scored")
            if not rollback:
                discard(*before)
            rates = _rates(scored)
            failed, improved = [], []
            for m in active:
                errors = rates[m]["train"][0]
                epoch[m] += 1
                if rollback and errors > best[m] and tries[m] < 5:
                    tries[m] += 1
                    firsts[m] = max(int(firsts[m] * 2 / 3 + 0.5), 2)
                    epoch[m] -= 1
                    failed.append(m)
                elif errors < best[m]:
                    best[m] = errors
                    improved.append(m)
                history.append({"member_id": m, "epoch": epoch[m], "step": steps[m], "train_errors": errors,
                                "eval_errors": rates[m].get("eval", (0, 0))[0], "rolled_back": m in failed})
            if rollback and improved:
                best_state = (_mixed(improved, weights, best_state[0], "weights"), _mixed(improved, scored, best_state[1], "scored"))
            if failed:
                weights = _mixed(failed, best_state[0], weights, "weights")
                scored = _mixed(failed, best_state[1], scored, "scored")
        return TrainResult(weights, offsets, history)
    finally:
        placed.unpersist()


def history_table(result: TrainResult, like: DataFrame) -> DataFrame:
    rows = [tuple(h.values()) for h in result.history]
    return like.sparkSession.createDataFrame(
        rows, "member_id LONG, epoch INT, step LONG, train_errors LONG, eval_errors LONG, rolled_back BOOLEAN")


def train_prototypes(features: DataFrame, epochs: int) -> tuple[DataFrame, list[dict]]:
    """Prototype passes whose threshold falls from 50 to 30 percent; the best eval pass is kept."""
    best, best_eval, old, history = None, -1, None, []
    for e in range(epochs):
        percent = max(50 - e * 20 // (epochs - 1 if epochs > 1 else 1), 30)
        protos = cut(prototypes(features, percent), "prototypes")
        scored = predictions(prototype_scores(features.where("split = 'eval'"), protos))
        ok = scored.agg(F.count_if(F.col("pred") == F.col("label"))).first()[0]
        changed = protos.agg(F.sum(F.bit_count("w"))).first()[0] if old is None else (
            prototype_flips(old, protos).agg(F.sum("flips")).first()[0])
        history.append({"epoch": e, "percent": percent, "eval_correct": ok, "flips": int(changed or 0)})
        if ok > best_eval:
            best, best_eval = protos, ok
        old = protos
    return best, history


def train_readout(features: DataFrame, n_features: int, classes: list[int] = CLASSES, regularisation: float = 0.1) -> dict[int, list[float]]:
    """Linear read-out on fixed features, squared error to +/-1 targets.

    `features` is (member_id, sample_id, split, label, z ARRAY<DOUBLE>) of one
    member. The normal equations are distributed sums; each class is one fit
    on the shared cached rows.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = features.where("split = 'train'").select(array_to_vector("z").alias("features"), "label").persist()
    out: dict[int, list[float]] = {}
    for k in classes:
        target = data.withColumn("target", F.when(F.col("label") == k, 1.0).otherwise(-1.0))
        model = LinearRegression(featuresCol="features", labelCol="target", regParam=regularisation, solver="normal",
                                 maxIter=1).fit(target)
        out[k] = [float(model.intercept), *[float(c) for c in model.coefficients]]
    data.unpersist()
    return out


def readout_scores(features: DataFrame, model: dict[int, list[float]]) -> DataFrame:
    """Class outputs of a read-out, wide by class."""
    def dot(coef: list[float]) -> Column:
        weights = const_array(coef[1:])
        products = F.zip_with("z", weights, lambda a, b: a * b)
        return F.aggregate(products, F.lit(coef[0]), lambda acc, x: acc + x)

    rest = [c for c in features.columns if c != "z"]
    return features.select(*rest, *[dot(c).alias(f"s{k}") for k, c in model.items()])
