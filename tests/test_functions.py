import random

import pytest
from pyspark.sql import functions as F

from bitquilt.functions.encodings import code_table, encode, encode_array, thermometer
from bitquilt.functions.words import pack_array, random_word, with_random_word
from bitquilt.names import ENCODINGS
from bitquilt.operators import grid, majority


def test_thermometer_saturates():
    assert [thermometer(n) for n in (-1, 0, 1, 3, 32, 40)] == [0, 0, 1, 7, 0xFFFFFFFF, 0xFFFFFFFF]


@pytest.mark.parametrize("encoding,value,level", [
    ("log", 32, 5), ("exp", 32, 4), ("mid", 192, 4), ("lin", 255, 7), ("down", 64, 3), ("up", 193, 4), ("tri", 128, 7),
])
def test_known_levels(encoding, value, level):
    assert code_table(encoding, 8)[value] == thermometer(level)


def test_unknown_encoding():
    with pytest.raises(ValueError):
        code_table("nope")


def test_encode_column_and_array_agree(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("v"))
    for e in ENCODINGS:
        one = [r[0] for r in df.select(encode(F.col("v"), e, 16), "v").orderBy("v").collect()]
        many = spark.range(1).select(encode_array(F.expr("sequence(0, 255)"), e, 16)).first()[0]
        assert one == many == list(code_table(e, 16))


def test_random_word_matches_driver(spark):
    seeds = [0, 42, 2**40 + 7]
    df = spark.range(50).withColumn("seed", F.explode(F.lit(seeds)))
    rows = with_random_word(df, F.col("seed"), F.col("id")).collect()
    assert all(r["w"] == random_word(r["seed"], r["id"]) for r in rows)


def test_pack_widths(spark):
    values = list(range(1, 9))
    for width in (8, 16, 32):
        per = 32 // width
        got = spark.range(1).select(pack_array(F.expr("cast(sequence(1, 8) as array<bigint>)"), width, 8)).first()[0]
        want = [sum(values[h * per + k] << (k * width) for k in range(per)) for h in range(8 // per)]
        assert got == want


def count_bits(words, need):
    return sum(1 << b for b in range(32) if sum((w >> b) & 1 for w in words) >= need)


def tree_by_hand(words, base):
    """Direct statement of the tree rules, one level at a time."""
    need = {3: {1: 1, 2: 2, 3: 2, 4: 3, 5: 3}, 4: {1: 1, 2: 1, 3: 1, 4: 2}, 5: {1: 1, 2: 2, 3: 3, 4: 4, 5: 4},
            7: {1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5, 7: 5}}[base]
    while len(words) > 1:
        rest, level = list(words), []
        if base == 7 and len(rest) % 7 == 1 and len(rest) > 7:
            rest = rest[:-1]
        while rest:
            size = base
            if base == 3 and len(rest) in (4, 5) and len(words) > len(rest) - 1 and len(words) > 5:
                size = len(rest)
            elif base == 3 and len(words) in (4, 5):
                size = 3
            level.append(count_bits(rest[:size], need[len(rest[:size])]))
            rest = rest[size:]
        words = level
    return words[0]


@pytest.mark.parametrize("base", [3, 4, 5, 7])
def test_trees(spark, base):
    rng = random.Random(base)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 15, 22, 29):
        words = [rng.getrandbits(32) for _ in range(n)]
        df = spark.createDataFrame([(words,)], "m ARRAY<BIGINT>")
        assert majority.majority_tree(df, "m", n, base).first()["w"] == tree_by_hand(words, base), n


def test_exact_majority_counts_every_bit(spark):
    rng = random.Random(1)
    groups = {g: [rng.getrandbits(32) for _ in range(rng.randint(1, 40))] for g in range(20)}
    rows = [(g, w) for g, ws in groups.items() for w in ws]
    df = spark.createDataFrame(rows, "g INT, w LONG")
    for half in (0, 3, 10):
        got = {r["g"]: r["w"] for r in majority.majority_exact(df, ["g"], "w", half).collect()}
        assert got == {g: count_bits(ws, half + 1) for g, ws in groups.items()}


def test_thresholds():
    assert majority.threshold(196, "auto") == 107 and majority.threshold(100, "auto") == 52
    assert majority.threshold(16) == 8 and majority.threshold(16, 5) == 5


def test_moves_compose(spark):
    s = grid.Shape(8, 8)
    px = F.expr("sequence(0, 63)")
    both = grid.apply_xform(px, "rot90@rot270", s)
    step = grid.apply_xform(grid.apply_xform(px, "sft-u1", s), "rot45", s)
    row = spark.range(1).select(both.alias("a"), step.alias("b"), grid.apply_xform(px, "sft-u1@rot45", s).alias("c")).first()
    assert row["a"] == list(range(64)) and row["b"] == row["c"]


def test_move_errors():
    with pytest.raises(ValueError):
        grid.move_map("rot90", grid.Shape(8, 4))
    with pytest.raises(ValueError):
        grid.move_map("rot11", grid.Shape(8, 8))
