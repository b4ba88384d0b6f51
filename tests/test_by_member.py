"""Models that do not fit a broadcast: same rows as with a broadcast, and no exploded bits in the exchanges."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare

import __spark_entry__ as entry
from bitquilt.operators import by_member as bm
from bitquilt.operators import majority as mj
from bitquilt.operators import project as pj
from bitquilt.operators import reports as rp
from bitquilt.operators import score as sc


@pytest.fixture(params=["1MB", "-1"])
def threshold(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["score_samples", "prototype_score", "majority_exact", "member_accuracy", "correct_pass"])
def test_queries_at_other_thresholds(spark, sf_dir, duck, threshold, name):
    assert compare(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) == ""


def rows_of(seed: int):
    r = random.Random(seed)
    words = [(m, s, "eval", s % 3, [r.getrandbits(32) for _ in range(r.choice([2, 2, 1, 0]))]) for m in range(3) for s in range(40)]
    weights = [(m, k, h, v, r.randint(-10**6, 10**6)) for m in range(2) for k in range(10) for h in range(2) for v in range(32)]
    offsets = [(m, k, r.randint(-100, 100)) for m in range(2) for k in range(10)]
    protos = [(m, k, h, r.getrandbits(32)) for m in range(2) for k in range(10) for h in range(2) if r.random() > 0.2]
    w0 = [(m, h, c, r.getrandbits(32)) for m in range(2) for h in range(3) for c in range(2)]
    return words, weights, offsets, protos, w0


@pytest.mark.parametrize("piece", [bm.PIECE_ROWS, 7])
def test_kernels_equal_joins(spark, monkeypatch, piece):
    monkeypatch.setattr(bm, "CHUNK_ROWS", 5)
    monkeypatch.setattr(bm.by_member, "__defaults__", (piece,))
    words, weights, offsets, protos, w0 = rows_of(piece)
    f = spark.createDataFrame(words, "member_id long, sample_id long, split string, label int, words array<long>")
    w = spark.createDataFrame(weights, "member_id long, class_id int, h int, v int, w long")
    o = spark.createDataFrame(offsets, "member_id long, class_id int, off long")
    p = spark.createDataFrame(protos, "member_id long, class_id int, h int, w long")
    z = spark.createDataFrame(w0, "member_id long, h int, c int, w long")
    runs = [lambda: sc.score_wide(f, w, o), lambda: rp.prototype_scores(f.where(F.size("words") > 0), p), lambda: pj.project(f, z, len(w0), 1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for run in runs:
        small = sorted(map(str, run().collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = run()
        got = [r for r in map(str, frame.collect()) if run is not runs[1] or "member_id=2" not in r]
        plan = frame._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sorted(got) == [r for r in small if run is not runs[1] or "member_id=2" not in r]
        assert "Generate explode(cast(array(0, 1, 2" not in plan and "posexplode" not in plan


def test_products_beyond_doubles_are_exact():
    bits = np.ones((2, 3), np.uint8)
    big = np.array([[1 << 60], [1], [1 << 60]])
    assert bm.bit_product(bits, big).tolist() == [[(1 << 61) + 1]] * 2


def test_majority_of_any_size(spark):
    rows = spark.range(200_001).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 < 7, 0x80000001).otherwise(0x7FFF0001).alias("w"))
    counts = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("w") == 0x80000001).alias("a")).collect()
    got = {r["g"]: r["w"] for r in mj.majority_exact(rows.withColumn("w", F.col("w").cast("bigint")), ["g"], "w", F.floor(F.col("_n") / 2)).collect()}
    assert got == {r["g"]: 1 + (0x80000000 if r["a"] > r["n"] // 2 else 0x7FFF0000 * (r["n"] - r["a"] > r["n"] // 2)) for r in counts}


@pytest.mark.parametrize("base,n", [(b, n) for b in (3, 4, 5, 7) for n in (1, 2, 8, 15, 16, 22, 50)])
def test_words_of_a_tree_level(base, n):
    assert sum(mj.tree_level(n, base)) == n - (base == 7 and n > 7 and n % 7 == 1)


@pytest.mark.parametrize("name", ["majority_rowwise", "majority_rowwise_single", "majority_pixel", "majority_pixel_rowwise"])
def test_line_majorities_group_no_samples(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*sample_id", plan) and "posexplode" not in plan


def on(values, width, half):
    return sum(1 << b for b in range(width) if sum(v >> b & 1 for v in values) > half)


def in_lines(values, size):
    return [values[i:i + size] for i in range(0, len(values), size)]


@pytest.mark.parametrize("n,per_row,width", [(16, 2, 8), (6, 3, 16), (5, 2, 8), (7, 7, 32), (1, 1, 8), (40, 5, 16)])
def test_line_majorities_by_hand(spark, n, per_row, width):
    r, groups = random.Random(n), 32 // width
    arrays = [[r.getrandbits(32) for _ in range(n * groups)] for _ in range(9)] + [[0xFFFFFFFF] * (n * groups), [0] * (n * groups)]
    df = spark.createDataFrame(list(enumerate(arrays)), "i long, m array<long>").repartition(3)
    half = per_row * groups // 2

    def rows(words, at):
        lines = in_lines(words, per_row) if n > per_row and n % per_row == 0 else None
        return on([on(x, 32, at) for x in lines], 32, at) if lines else on(words, 32, at)

    def fields(words):
        return [w >> width * k & (1 << width) - 1 for w in words for k in range(groups)]

    def joined(one):
        return lambda words: sum(one(words[g * n:(g + 1) * n]) << g * width for g in range(groups))

    def across(words):
        return on([on(fields(x), width, half) for x in in_lines(words, per_row)], width, n // per_row // 2)

    flat = df.select("i", F.slice("m", 1, n).alias("m"))
    runs = [(mj.majority_rowwise(flat, "m", n, per_row, at), lambda m, at=at: rows(m[:n], at)) for at in (-1, 0, 1, n)]
    runs.append((mj.majority_pixel(df, "m", n, width), joined(lambda x: on(fields(x), width, n * groups // 2))))
    runs.append((mj.majority_pixel_rowwise(df, "m", n, per_row, width), joined(across)))
    for got, by_hand in runs:
        assert {x["i"]: x["w"] for x in got.collect()} == {i: by_hand(m) for i, m in enumerate(arrays)}
