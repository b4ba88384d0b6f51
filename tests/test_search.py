"""Searches against exhaustive Python on a small score table."""

import itertools
import random

import pytest

from bitquilt.operators import score as sc
from bitquilt.operators import search as se

K = range(10)
MEMBERS, SAMPLES = range(6), range(50)


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(9)
    labels = {s: rng.randrange(10) for s in SAMPLES}
    return labels, {(m, s): [rng.randint(-100, 100) + (35 if k == labels[s] else 0) for k in K] for m in MEMBERS for s in SAMPLES}


@pytest.fixture(scope="module")
def frame(spark, scores):
    labels, table = scores
    rows = [(m, s, labels[s], *v) for (m, s), v in table.items()]
    return spark.createDataFrame(rows, "member_id LONG, sample_id LONG, label INT, " + ", ".join(f"s{k} LONG" for k in K))


def correct(scores, chosen, target=None, binary=False):
    labels, table = scores
    n = 0
    for s in SAMPLES:
        total = [sum(table[m, s][k] for m in chosen) for k in K]
        pred = total.index(max(total))
        if target is None:
            n += pred == labels[s]
        elif binary:
            n += (pred in target) == (labels[s] in target)
        else:
            n += pred == labels[s] and labels[s] in target
    return n


def greedy_by_hand(scores, min_gain):
    chosen, best = [], 0
    while len(chosen) < len(MEMBERS):
        top = max((m for m in MEMBERS if m not in chosen), key=lambda m: (correct(scores, chosen + [m]), -m))
        now = correct(scores, chosen + [top])
        if (now - best) * 100.0 / len(SAMPLES) <= min_gain:
            break
        chosen.append(top)
        best = now
    return chosen, best


@pytest.mark.parametrize("min_gain", [0.0, 2.0, 4.0])
def test_greedy(frame, scores, min_gain):
    found = se.greedy(se.Pool(frame), min_gain)
    assert (found.members, found.correct) == greedy_by_hand(scores, min_gain)


def test_equal_gain_is_refused(frame, scores):
    chosen, _ = greedy_by_hand(scores, 0.0)
    gain = (correct(scores, chosen[:2]) - correct(scores, chosen[:1])) * 100.0 / len(SAMPLES)
    first = correct(scores, chosen[:1]) * 100.0 / len(SAMPLES)
    assert gain < first
    assert se.greedy(se.Pool(frame), gain).members == chosen[:1]


def test_candidates(frame, scores):
    slots = [(0,), (1, 2), (3, 4, 5)]
    rows = se.Pool(frame).candidates(slots).collect()
    assert {(r["slot"], r["member_id"]): r["correct"] for r in rows} == {
        (i, m): correct(scores, [*s, m]) for i, s in enumerate(slots) for m in MEMBERS if m not in s}


def test_wide_beam_reports_its_own_set(frame, scores):
    found = se.beam(se.Pool(frame), 20)
    assert found.correct == correct(scores, found.members)
    assert found.correct >= greedy_by_hand(scores, 0.0)[1]
    for n in range(1, len(found.members)):
        best_n = max(correct(scores, c) for c in itertools.combinations(MEMBERS, n))
        assert best_n < found.correct


def test_beam_from_a_set_only_adds(frame):
    found = se.beam(se.Pool(frame), 3, start=[(2, 3)])
    assert {2, 3} <= set(found.members)


def test_locked_members_stay_out(frame):
    assert not {0, 1} & set(se.beam(se.Pool(frame), 3, locked=(0, 1)).members)


def test_block_acceptance_keeps_the_best_committed_set(frame, scores):
    found = se.greedy(se.Pool(frame), 5.0, block=3)
    assert found.correct == correct(scores, found.members)


@pytest.mark.parametrize("cap", [1, 2, 3, 4])
def test_blocks_stay_within_the_member_cap(frame, scores, cap):
    for found in (se.beam(se.Pool(frame), 2, 6.0, max_members=cap, block=4), se.greedy(se.Pool(frame), 6.0, max_members=cap, block=4)):
        assert len(found.members) <= cap and found.correct == correct(scores, found.members)
        assert all(step["en"] <= cap for step in found.path)


def test_a_block_buffers_small_gains(frame, scores):
    """With a gain that no single step has, the first commit is the first level whose sum of gains passes it."""
    sizes = [max(correct(scores, c) for c in itertools.combinations(MEMBERS, n)) for n in range(1, 7)]
    need = (sizes[0] + 1) * 100.0 / len(SAMPLES)
    assert se.beam(se.Pool(frame), 64, need).members == []
    found = se.beam(se.Pool(frame), 64, need, block=6)
    first = next(n for n, c in enumerate(sizes, 1) if c * 100.0 / len(SAMPLES) > need)
    assert found.path[0]["en"] == first and found.path[0]["correct"] == sizes[first - 1]


def test_swaps(frame, scores):
    start = [0, 1, 2]
    rows = se.swap_candidates(se.Pool(frame), start).collect()
    assert {(r["out_id"], r["in_id"]): r["correct"] for r in rows} == {
        (o, i): correct(scores, [m for m in start if m != o] + [i]) for o in start for i in (3, 4, 5)}
    found = se.swap_search(se.Pool(frame), start)
    now, best = start, correct(scores, start)
    while True:
        o, i = max(((o, i) for o in now for i in MEMBERS if i not in now),
                   key=lambda p: (correct(scores, [m for m in now if m != p[0]] + [p[1]]), -p[0], -p[1]))
        after = sorted([m for m in now if m != o] + [i])
        if correct(scores, after) <= best:
            break
        now, best = after, correct(scores, after)
    assert (found.members, found.correct) == (now, best)


@pytest.mark.parametrize("binary", [False, True])
def test_targets(frame, scores, binary):
    pool = se.Pool(frame, se.Goal((1, 2, 3), binary))
    assert pool.evaluate([0, 4]) == correct(scores, [0, 4], (1, 2, 3), binary)
    rows = pool.candidates([(0,)]).collect()
    assert {r["member_id"]: r["correct"] for r in rows} == {m: correct(scores, [0, m], (1, 2, 3), binary) for m in range(1, 6)}


def test_restarts_and_one_member(frame, scores):
    assert se.beam_restarts(se.Pool(frame), 2, 2).correct >= max(correct(scores, [m]) for m in MEMBERS)
    alone = se.Pool(frame.where("member_id = 3"))
    assert se.beam(alone, 5).members == [3] and se.greedy(alone).members == [3]


def test_curve_end_is_the_ensemble(frame, scores):
    from bitquilt.operators import reports as rp

    curve = rp.with_curve_steps(rp.accuracy_curve(frame, ["member_id"]), ["member_id"]).orderBy("en").collect()
    assert [r["correct"] for r in curve] == [correct(scores, list(MEMBERS)[: n + 1]) for n in MEMBERS]
    assert sc.accuracy(sc.predictions(sc.ensemble_sum(frame, ["sample_id", "label"])), []).first()["correct"] == curve[-1]["correct"]
