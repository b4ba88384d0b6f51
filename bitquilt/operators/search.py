"""Ensemble search: find the member subset with the best accuracy.

One level of any search is one job. The state is one row per sample holding
the summed class scores of every open slot (at most 64); each score row meets
its sample's row once, the slots are unrolled in the task, and counts are
combined before the exchange. Only slots x candidates counters are shuffled
and only the chosen slots reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import const_array
from .learn import CLASSES
from .score import best_class, class_columns, counted_flag, hit_flag, margin

MAX_SLOTS = 64


@dataclass(frozen=True)
class Slot:
    members: tuple[int, ...] = ()
    correct: int = 0


@dataclass
class SearchResult:
    members: list[int]
    correct: int
    total: int
    path: list[dict] = field(default_factory=list)

    @property
    def acc(self) -> float:
        return self.correct * 100.0 / self.total if self.total else 0.0


@dataclass(frozen=True)
class Goal:
    """What counts as correct: all classes, target classes, or target against the rest."""

    target: tuple[int, ...] | None = None
    binary: bool = False

    def hit(self):
        return hit_flag(F.col("pred"), F.col("label"), list(self.target) if self.target else None, self.binary)

    def counted(self):
        return counted_flag(F.col("label"), list(self.target) if self.target else None, self.binary)


class Pool:
    """Scores of the candidates, placed by sample and kept for every level.

    `keep=False` leaves the scores where they are, for a single level.
    """

    def __init__(self, scores: DataFrame, goal: Goal = Goal(), classes: list[int] = CLASSES, keep: bool = True):
        self.classes, self.goal = classes, goal
        self.columns = class_columns(classes)
        kept = scores.select("member_id", "sample_id", "label", *self.columns)
        if goal.target and not goal.binary:
            kept = kept.where(F.col("label").isin(list(goal.target)))
        self.scores = kept.repartition("sample_id").persist() if keep else kept
        self.total = self.scores.select("sample_id", "label").distinct().agg(F.sum(goal.counted())).first()[0] or 0
        # catalogue-sized: one row per member
        self.ids = sorted(r[0] for r in self.scores.select("member_id").distinct().collect())

    def close(self) -> None:
        self.scores.unpersist()

    def slot_sums(self, weights: list[dict[int, int]]) -> DataFrame:
        """Per sample, an array with the class sums of every slot.

        A slot is a signed member list; the sums are conditional aggregates in
        one pass over the members that appear in any slot.
        """
        used = sorted({m for w in weights for m in w})
        rows = self.scores.where(F.col("member_id").isin(used)) if used else self.scores
        per_slot = []
        for i, w in enumerate(weights):
            factor = F.lit(0)
            for sign in sorted(set(w.values())):
                factor = F.when(F.col("member_id").isin([m for m, s in w.items() if s == sign]), sign).otherwise(factor)
            fields = [F.sum(F.col(c) * factor).cast("bigint").alias(f"b{k}") for k, c in zip(self.classes, self.columns)]
            per_slot.append(F.struct(F.lit(i).alias("slot"), *fields))
        return rows.groupBy("sample_id").agg(F.array(*per_slot).alias("_slots"))

    def candidates(self, slots: list[tuple[int, ...]]) -> DataFrame:
        """(slot, member_id, correct, margin) of every slot extended by every member outside it."""
        sums = self.slot_sums([{m: 1 for m in s} for s in slots])
        joined = self.scores.join(sums, "sample_id")
        opened = joined.select("member_id", "label", *self.columns, F.inline("_slots"))
        members = F.element_at(const_array([list(s) or [-1] for s in slots]), F.col("slot") + 1)
        opened = opened.where(~F.array_contains(members.cast("array<bigint>"), F.col("member_id")))
        return self._count(opened, ["slot", "member_id"])

    def _count(self, opened: DataFrame, keys: list[str]) -> DataFrame:
        totals = [(F.col(c) + F.col(f"b{k}")) for k, c in zip(self.classes, self.columns)]
        judged = opened.select(*keys, "label", best_class(totals, self.classes).alias("pred"), margin(totals).alias("_m"))
        return judged.groupBy(*keys).agg(F.sum(self.goal.hit()).cast("bigint").alias("correct"), F.sum("_m").alias("margin"))

    def evaluate(self, members: list[int] | tuple[int, ...]) -> int:
        """Correct count of a set."""
        if not members:
            return 0
        rows = self.scores.where(F.col("member_id").isin(list(members)))
        sums = rows.groupBy("sample_id", "label").agg(*[F.sum(c).alias(c) for c in self.columns])
        judged = sums.select("label", best_class([F.col(c) for c in self.columns], self.classes).alias("pred"))
        return judged.agg(F.sum(self.goal.hit())).first()[0] or 0

    def singles(self) -> DataFrame:
        cols = [F.col(c) for c in self.columns]
        judged = self.scores.select("member_id", "label", best_class(cols, self.classes).alias("pred"))
        return judged.groupBy("member_id").agg(F.sum(self.goal.hit()).cast("bigint").alias("correct"))


def greedy(
    pool: Pool, min_gain: float = 0.0, start: tuple[int, ...] = (), max_members: int | None = None,
    clarity: DataFrame | None = None, block: int | None = None,
) -> SearchResult:
    """Add the best member while the accuracy grows by more than min_gain.

    clarity: among members that do not lower the accuracy take the clearest.
    block: buffer any gain, commit the buffered members once their summed gain
    exceeds min_gain, stop after `block` steps without a commit and return the
    best committed set.
    """
    chosen, committed = list(start), list(start)
    correct = pool.evaluate(start)
    base = correct
    best = (correct, list(committed))
    path, waited = [], 0
    scale = 100.0 / max(pool.total, 1)
    cap = max_members or len(pool.ids)
    while len(committed) < cap and len(chosen) < len(pool.ids):
        level = pool.candidates([tuple(chosen)])
        if clarity is not None:
            level = level.where(F.col("correct") >= base).join(clarity.select("member_id", "clarity"), "member_id")
            order = [F.desc("clarity"), F.asc("member_id")]
        else:
            order = [F.desc("correct"), F.asc("member_id")]
        top = level.orderBy(*order).first()
        if top is None:
            break
        gain = (top["correct"] - base) * scale
        if block is not None and gain > 0:
            chosen.append(top["member_id"])
            if gain > min_gain:
                room = cap - len(committed)
                fresh = [m for m in chosen if m not in committed]
                committed += fresh[:room]
                correct = top["correct"] if len(fresh) <= room else pool.evaluate(committed)
                base, waited = correct, 0
                path.append({"en": len(committed), "member_id": top["member_id"], "correct": correct})
                if correct > best[0]:
                    best = (correct, list(committed))
                continue
            waited += 1
            if waited >= block:
                break
        elif block is None and gain > min_gain:
            chosen.append(top["member_id"])
            committed = list(chosen)
            base = correct = top["correct"]
            best = (correct, list(committed))
            path.append({"en": len(committed), "member_id": top["member_id"], "correct": correct})
        else:
            break
    return SearchResult(best[1], best[0], pool.total, path)


def expansions(level: DataFrame, slots: list[Slot], order: str = "eval", clarity: DataFrame | None = None) -> DataFrame:
    """Level rows with their sort key and the sorted member set they would form."""
    sets = F.element_at(const_array([list(s.members) or [-1] for s in slots]), F.col("slot") + 1).cast("array<bigint>")
    parent = F.element_at(const_array([s.correct for s in slots], "bigint"), F.col("slot") + 1)
    level = level.withColumn("members", F.array_sort(F.array_union(F.filter(sets, lambda m: m >= 0), F.array("member_id"))))
    if order == "clarity":
        return level.join(clarity.select("member_id", F.col("clarity").alias("key")), "member_id")
    key = F.col("correct") - parent if order == "marginal" else F.col("correct")
    return level.withColumn("key", key.cast("double"))


def beam_cut(rows: DataFrame, width: int, skip: int = 1) -> DataFrame:
    """From the skip-th best on, the first `width` distinct member sets.

    A set reached from several slots appears once, with its best row.
    """
    best = rows.groupBy("members").agg(
        F.max(F.struct("key", "margin", (-F.col("member_id")).alias("_m"), "slot", "correct")).alias("_b"))
    flat = best.select("members", "_b.key", "_b.margin", (-F.col("_b._m")).alias("member_id"), "_b.slot", "_b.correct")
    return flat.orderBy(F.desc("key"), F.desc("margin"), F.asc("member_id"), F.asc("slot")).offset(skip - 1).limit(min(width, MAX_SLOTS))


def beam(
    pool: Pool, width: int = 10, min_gain: float = 0.0, start: list[tuple[int, ...]] | None = None,
    max_members: int | None = None, order: str = "eval", clarity: DataFrame | None = None, block: int | None = None,
    locked: tuple[int, ...] = (), skip: int = 1,
) -> SearchResult:
    """Beam search by additions; the returned set is evaluated once more as a set.

    block: a level whose gain over the last committed set is too small is buffered, and its members go into the set that a later level commits;
    the search ends after `block` levels without a commit. The best committed set is returned; no set has more than
    `max_members` members, unless a start set has.
    """
    width = min(width, MAX_SLOTS)
    slots = [Slot(tuple(sorted(s)), pool.evaluate(s)) for s in (start or [()])]
    best = max(slots, key=lambda s: s.correct)
    accepted = best
    path, waited = [], 0
    scale = 100.0 / max(pool.total, 1)
    cap = max_members or len(pool.ids)
    while slots := [s for s in slots if len(s.members) < cap]:
        level = pool.candidates([s.members for s in slots])
        if locked:
            level = level.where(~F.col("member_id").isin(list(locked)))
        rows = beam_cut(expansions(level, slots, order, clarity), width, skip).collect()  # at most 64 rows
        skip = 1
        if not rows:
            break
        slots = [Slot(tuple(r["members"]), r["correct"]) for r in rows]
        top = max(slots, key=lambda s: s.correct)
        gain = (top.correct - accepted.correct) * scale
        if gain > min_gain:
            accepted = top
            waited = 0
            path.append({"en": len(top.members), "members": list(top.members), "correct": top.correct})
            if top.correct > best.correct:
                best = top
        elif block is not None:
            waited += 1
            if waited >= block:
                break
        else:
            break
    return SearchResult(list(best.members), pool.evaluate(best.members), pool.total, path)


def swap_candidates(pool: Pool, chosen: list[int]) -> DataFrame:
    """(out_id, in_id, correct) of every exchange of one chosen member for one outside.

    The same kernel as a beam level: a slot is the set without one member.
    """
    slots = [tuple(m for m in chosen if m != out) for out in chosen]
    inside = list(chosen)
    parts = []
    for i in range(0, len(slots), MAX_SLOTS):
        outs = const_array(inside[i : i + MAX_SLOTS], "bigint")
        level = pool.candidates(slots[i : i + MAX_SLOTS]).where(~F.col("member_id").isin(inside))
        parts.append(level.select(F.element_at(outs, F.col("slot") + 1).alias("out_id"), F.col("member_id").alias("in_id"), "correct"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def swap_search(pool: Pool, chosen: list[int], max_passes: int | None = None) -> SearchResult:
    """Best exchange per pass until none lowers the errors, or `max_passes` are done; errors fall strictly, so it ends."""
    chosen = sorted(chosen)
    correct = pool.evaluate(chosen)
    path = []
    while max_passes is None or len(path) < max_passes:
        top = swap_candidates(pool, chosen).orderBy(F.desc("correct"), "out_id", "in_id").first()
        if top is None or top["correct"] <= correct:
            break
        chosen = sorted([m for m in chosen if m != top["out_id"]] + [top["in_id"]])
        correct = top["correct"]
        path.append({"out_id": top["out_id"], "in_id": top["in_id"], "correct": correct})
    return SearchResult(chosen, correct, pool.total, path)


def restart_order(pool: Pool, seed: int | None = None) -> DataFrame:
    """Start members: strongest first, or in a seeded order."""
    singles = pool.singles()
    if seed is None:
        return singles.orderBy(F.desc("correct"), F.asc("member_id"))
    return singles.orderBy(F.xxhash64(F.lit(seed), "member_id"), "member_id")


def beam_restarts(pool: Pool, tries: int, width: int = 10, min_gain: float = 0.0, seed: int | None = None, lock: bool = False) -> SearchResult:
    """Beam searches from different start members; the best result wins.

    lock: members found by one try are not available to the next.
    """
    starts = [r["member_id"] for r in restart_order(pool, seed).limit(tries + len(pool.ids) * lock).collect()]
    best, taken, done = None, set(), 0
    for s in starts:
        if done == tries or s in taken:
            continue
        done += 1
        found = beam(pool, width, min_gain, [(s,)], locked=tuple(sorted(taken)))
        if lock:
            taken |= set(found.members)
        if best is None or found.correct > best.correct:
            best = found
    return best
