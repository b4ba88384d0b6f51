"""Projection of packed words through frozen random words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import bind, const_array
from ..functions.words import explode_words, split_groups, with_random_word, xnor
from ..session import fits_broadcast, join_side
from .by_member import Kernel, bit_matrix, by_member, in_chunks, schema_of, word_matrix
from .majority import majority_exact


def member_seeds(seed: int, mode: str, per_ensemble: int, words_per_member: int, member: str = "member_id") -> tuple[Column, Column]:
    """Seed and first draw of every member.

    once: one stream over all members; incr: the seed grows with the member;
    const: all members of one ensemble share a seed.
    """
    m = F.col(member)
    zero = F.lit(0).cast("bigint")
    if mode == "once":
        return F.lit(seed).cast("bigint"), m * words_per_member
    if mode == "incr":
        return m + seed, zero
    if mode == "const":
        return F.floor(m / per_ensemble) + seed, zero
    raise ValueError(f"unknown seed mode {mode!r}")


def random_matrix(members: DataFrame, h: int, nc: int, seed: Column, first: Column | int = 0) -> DataFrame:
    """W0 as rows (member_id, h, c, w); draw `first + h*nc + c` of the member's seed."""
    cells = (
        members.select("member_id", seed.alias("_seed"), F.lit(first).alias("_first") if isinstance(first, int) else first.alias("_first"))
        .withColumn("h", F.explode(const_array(range(h))))
        .withColumn("c", F.explode(const_array(range(nc))))
    )
    drawn = with_random_word(cells, F.col("_seed"), F.col("_first") + F.col("h") * nc + F.col("c"))
    return drawn.select("member_id", "h", "c", "w")


def match_words(words: DataFrame, w0: DataFrame, n_cells: int) -> DataFrame:
    """XNOR of every word (member_id, sample_id, c, w) with the random words of its position.

    `w0` has `n_cells` rows and is broadcast only while that number fits the
    session's threshold.
    """
    joined = join_side(words, w0.withColumnRenamed("w", "_w0"), ["member_id", "c"], n_cells)
    return joined.withColumn("w", xnor(F.col("w"), F.col("_w0"))).drop("_w0")


def _placed_words(features: DataFrame) -> DataFrame:
    # placing the compact rows by sample serves the later aggregation as well,
    # so the exploded matches are never shuffled
    placed = features.select("member_id", "sample_id", "words").repartition("sample_id")
    return explode_words(placed).withColumnRenamed("h", "c")


def project(features: DataFrame, w0: DataFrame, n_cells: int, half: int) -> DataFrame:
    """Hidden words: majority over c of the matches, as (member_id, sample_id, h, w).

    Random words that do not fit a broadcast meet packed rows in pieces of a member (`by_member`).
    """
    if not fits_broadcast(features.sparkSession, n_cells, 32):
        given = features.select("member_id", "sample_id", "words").where(F.size("words") > 0)
        return by_member(given, w0.select("member_id", "h", "c", "w"), project_kernel(half), schema_of(given, ["member_id", "sample_id"], "h int, w bigint"))
    matches = match_words(_placed_words(features), w0, n_cells)
    return majority_exact(matches, ["member_id", "sample_id", "h"], "w", half, most=n_cells)


def project_kernel(half: int) -> Kernel:
    def project_piece(rows: pa.Table, cells: pa.Table) -> pa.Table:
        words, sizes = word_matrix(rows.column("words"))
        h, c, w = (np.asarray(cells.column(x).combine_chunks(), np.int64) for x in ("h", "c", "w"))
        units, parts = np.unique(h), []
        for unit in units:
            at, random = c[h == unit], w[h == unit].astype("<u4")
            at, random = at[at < words.shape[1]], random[at < words.shape[1]]

            def majority(part: np.ndarray, at: np.ndarray = at, random: np.ndarray = random) -> np.ndarray:
                x, inside = part[:, :-1][:, at], at < part[:, -1:]
                same = np.where(inside, ~(x ^ random), 0).astype("<u4")
                counts = np.zeros((len(x), 32), np.int64)
                for i in range(len(at)):
                    counts += bit_matrix(same[:, i:i + 1])
                on = np.packbits(counts > half, axis=1, bitorder="little")
                return np.ascontiguousarray(on).view("<u4").astype(np.int64)

            parts.append(in_chunks(np.concatenate([words, sizes[:, None]], axis=1), majority, 1)[:, 0])
        n = rows.num_rows
        take = np.repeat(np.arange(n), len(units))
        hidden = np.stack(parts, axis=1).reshape(-1) if parts else np.empty(0, np.int64)
        return pa.table({
            "member_id": rows.column("member_id").take(take), "sample_id": rows.column("sample_id").take(take),
            "h": pa.array(np.tile(units, n), pa.int32()), "w": hidden,
        })

    return project_piece


def project_inline(features: DataFrame, h: int, nc: int, seed: Column, half: int) -> DataFrame:
    """The same projection without a join, for matrices too large to broadcast.

    A random word depends on its seed and number alone, so it is drawn where
    the sample word is.
    """
    cells = _placed_words(features).withColumnRenamed("w", "_x").withColumn("h", F.explode(const_array(range(h))))
    drawn = with_random_word(cells, seed, F.col("h") * nc + F.col("c"), "_w0")
    matches = drawn.withColumn("w", xnor(F.col("_x"), F.col("_w0")))
    return majority_exact(matches, ["member_id", "sample_id", "h"], "w", half, most=nc)


def match_arrays(features: DataFrame, w0: DataFrame, n_cells: int) -> DataFrame:
    """Matches of one hidden unit as an ordered array, for position-dependent trees."""
    rows = gather_words(w0.select("member_id", F.col("h").alias("u"), F.col("c").alias("h"), "w"), ["member_id", "u"], "_row")
    joined = join_side(features, rows, ["member_id"], n_cells, 16)
    match = F.zip_with("words", "_row", xnor)
    return joined.select("member_id", "sample_id", F.col("u").alias("h"), match.alias("match"))


def gather_words(hidden: DataFrame, keys: list[str], out: str = "words") -> DataFrame:
    """Rows (keys, h, w) back to one ordered array per key."""
    return hidden.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("_p")).select(
        *keys, F.col("_p.w").alias(out)
    )


def group_bits(words: Column, group: int) -> Column:
    return F.transform(words, lambda w: split_groups(w, group))


def leaky_features(samples: DataFrame, members: DataFrame, n_members: int, h: int, n_in: int, seed: Column, x: str = "x", slope: float = 0.05) -> DataFrame:
    """leaky(x . W0) with W0 uniform in +/- 1/sqrt(n); `samples` is (member_id, sample_id, x)."""
    cells = random_matrix(members, h, n_in, seed)
    bound = 1.0 / (n_in ** 0.5)
    weights = cells.select("member_id", "h", "c", ((F.col("w") / float(1 << 32) * 2.0 - 1.0) * bound).alias("_g"))
    values = samples.select("member_id", "sample_id", x).repartition("sample_id")
    values = values.select("member_id", "sample_id", F.posexplode_outer(x).alias("c", "_x"))
    joined = join_side(values, weights, ["member_id", "c"], n_members * h * n_in)
    z = joined.groupBy("member_id", "sample_id", "h").agg(F.sum(F.col("_x") * F.col("_g")).alias("z"))
    return z.withColumn("z", F.when(F.col("z") < 0, F.col("z") * slope).otherwise(F.col("z")))


def float_pack(px: Column, n: int, per: int = 4) -> Column:
    """Mean of `per` neighbouring bytes scaled to [-1, 1]."""
    def mean(p: Column, i: Column) -> Column:
        total = p[i * per]
        for k in range(1, per):
            total = total + p[i * per + k]
        return total / float(per) / 127.5 - 1.0

    return bind(px, lambda p: F.transform(const_array(range(n // per)), lambda i: mean(p, i)))
