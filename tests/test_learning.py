"""Counting, scoring and correction against plain Python on a small table."""

import math
import random

import pytest

from bitquilt.operators import learn as ln
from bitquilt.operators import reports as rp
from bitquilt.operators import score as sc
from bitquilt.operators import train as tr

SCALE = 1 << 17
K = range(10)


@pytest.fixture(scope="module")
def table():
    """Class 9 has no training row, sample 0 has no set bit, bit 31 of word 1 never fires."""
    rng = random.Random(5)
    rows = []
    for s in range(60):
        label = s % 9 if s % 5 else 9
        words = [rng.getrandbits(32) & rng.getrandbits(32), rng.getrandbits(31)]
        rows.append((0, s, "eval" if s % 5 == 0 else "train", label, [0, 0] if s == 0 else words))
    return rows


@pytest.fixture(scope="module")
def features(spark, table):
    return spark.createDataFrame(table, "member_id LONG, sample_id LONG, split STRING, label INT, words ARRAY<BIGINT>")


def fixed(x):
    return int(math.copysign(math.floor(abs(x) * SCALE + 0.5), x))


def set_bits(words):
    return [(h, v) for h, w in enumerate(words) for v in range(32) if w >> v & 1]


def model_by_hand(table):
    n = {k: sum(1 for r in table if r[2] == "train" and r[3] == k) for k in K}
    t = {(k, h, v): 0 for k in K for h in range(2) for v in range(32)}
    for _, _, split, label, words in table:
        if split == "train":
            for h, v in set_bits(words):
                t[label, h, v] += 1
    w = {key: 0 if n[key[0]] == 0 else fixed(math.log((c + 1) / (n[key[0]] + 2) / (1 - (c + 1) / (n[key[0]] + 2)))) for key, c in t.items()}
    off = {k: 0 if n[k] == 0 else fixed(sum(math.log((n[k] - t[k, h, v] + 1) / (n[k] + 2)) for h in range(2) for v in range(32))) for k in K}
    return w, off


def scores_by_hand(words, w, off):
    return [off[k] + sum(w[k, h, v] for h, v in set_bits(words)) for k in K]


def test_model_and_scores(features, table):
    weights, offsets = ln.fit(features)
    w, off = model_by_hand(table)
    assert {(r["class_id"], r["h"], r["v"]): r["w"] for r in weights.collect()} == w
    assert {r["class_id"]: r["off"] for r in offsets.collect()} == off
    got = {r["sample_id"]: [r[f"s{k}"] for k in K] for r in sc.score_wide(features, weights, offsets).collect()}
    assert got == {r[1]: scores_by_hand(r[4], w, off) for r in table}


def pass_by_hand(table, w, off, step, gap_scaled=True):
    delta = {}
    for _, _, split, label, words in table:
        if split != "train":
            continue
        s = scores_by_hand(words, w, off)
        pred = s.index(max(s))
        gap = s[pred] - s[label]
        if pred == label or (gap_scaled and gap <= 0):
            continue
        size = step if not gap_scaled or gap >= SCALE else max((step * gap) >> 17, 1)
        for h, v in set_bits(words):
            delta[label, h, v] = delta.get((label, h, v), 0) + size
            delta[pred, h, v] = delta.get((pred, h, v), 0) - size
    return {key: x + delta.get(key, 0) for key, x in w.items()}


@pytest.mark.parametrize("gap_scaled", [True, False])
def test_correction_pass(features, table, gap_scaled):
    weights, offsets = ln.fit(features)
    w, off = model_by_hand(table)
    out = tr.correct_pass(features.where("split = 'train'"), weights, offsets, 9000, gap_scaled)
    assert {(r["class_id"], r["h"], r["v"]): r["w"] for r in out.collect()} == pass_by_hand(table, w, off, 9000, gap_scaled)


def test_training_epochs(features, table):
    w, off = model_by_hand(table)
    errors = []
    for e in range(2):
        w = pass_by_hand(table, w, off, tr.step_at(e, 2, 9000))
        errors.append(sum(1 for r in table if r[2] == "train" and (s := scores_by_hand(r[4], w, off)).index(max(s)) != r[3]))
    result = tr.train_correct(features, 2, 9000)
    assert [h["train_errors"] for h in result.history] == errors
    assert {(r["class_id"], r["h"], r["v"]): r["w"] for r in result.weights.collect()} == w


def test_rollback_never_keeps_a_worse_state(features):
    result = tr.train_correct(features, 3, 1 << 20, rollback=True)
    kept = [h["train_errors"] for h in result.history if not h["rolled_back"]]
    back = [h for h in result.history if h["rolled_back"]]
    assert len(back) <= 5 and (len(back) == 5 or kept == sorted(kept, reverse=True))


def test_step_schedule():
    assert tr.step_at(0, 10, 1000, warmup=4) == 250 and tr.step_at(4, 10, 1000, warmup=4) == 1000
    assert tr.step_at(10, 10, 1000) == 2
    assert tr.step_at(0, 10, 1000, gap_k=2.0, gap=0.5) == int(1000 * math.exp(-1.0) + 0.5)


def test_ties_and_zero_votes(spark):
    rows = [(1, *[5] * 10), (2, 0, 7, 7, *[1] * 7), (3, *[0] * 10), (4, -3, 0, -2, *[0] * 7)]
    df = spark.createDataFrame(rows, "id INT, " + ", ".join(f"s{k} LONG" for k in K))
    cols = [df[f"s{k}"] for k in K]
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", sc.best_class(cols).alias("a"), sc.best_class_nonzero(cols).alias("b")).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, None), 4: (1, 2)}


def test_prototype_passes(features):
    protos, history = tr.train_prototypes(features, 3)
    assert [h["percent"] for h in history] == [50, 40, 30]
    assert protos.count() == 2 * 10
    assert rp.prototype_flips(protos, protos).first()["flips"] == 0
