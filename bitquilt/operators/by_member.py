"""Members' rows against their member's model, when the models of all members are too large to broadcast.

Packed feature rows are dealt into pieces of bounded size, so that a member with very many samples is worked on by many
tasks; a member's model goes to each of its pieces. Bits are never exploded and never shuffled: inside a piece they are
a matrix that meets the model by one product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_side

#: Feature rows of a piece, and rows turned into bits at once.
PIECE_ROWS = 1 << 15
CHUNK_ROWS = 1 << 10
#: Sums below this are exact in doubles.
EXACT = 1 << 53

Kernel = Callable[[pa.Table, pa.Table], pa.Table]


def by_member(features: DataFrame, model: DataFrame, kernel: Kernel, schema: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """kernel(feature rows, model rows) for every piece of every member; both tables have member_id.

    A piece is about `piece_rows` samples of a member; a member's model rows are copied to its pieces, so the copies grow with the samples
    by one model per `piece_rows` of them. Members without a model have no rows.
    """
    parts = features.groupBy("member_id").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("_parts"))
    n_members = parts.count()
    dealt = join_side(features, parts, ["member_id"], n_members).withColumn("_part", F.pmod(F.xxhash64("sample_id"), F.col("_parts")).cast("int"))
    cells = [F.col(c).alias(c) for c in model.columns if c != "member_id"]
    sizes = parts.select(F.col("member_id").alias("_member"), F.col("_parts").alias("_copies"))
    copies = model.select(F.col("member_id").alias("_member"), *cells).join(sizes, "_member")
    copies = copies.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    pieces = dealt.drop("_parts").groupBy("member_id", "_part").cogroup(copies.groupBy("_member", "_piece"))
    return pieces.applyInArrow(kernel, schema)


def schema_of(features: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keys), more])


def word_matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The word lists of rows as a matrix filled with zeros, and their lengths."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), "<u4")
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def bit_matrix(words: np.ndarray) -> np.ndarray:
    """One column per bit, the low bit of the first word first."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")


def bit_product(bits: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact integer product of bits with a matrix of integers."""
    if np.abs(matrix.astype(np.float64)).sum(axis=0).max(initial=0) < EXACT:
        return (bits.astype(np.float64) @ matrix.astype(np.float64)).astype(np.int64)
    return bits.astype(np.int64) @ matrix


def in_chunks(words: np.ndarray, of_chunk: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int64)
    for a in range(0, len(words), CHUNK_ROWS):
        out[a:a + CHUNK_ROWS] = of_chunk(words[a:a + CHUNK_ROWS])
    return out


def fitted(words: np.ndarray, n: int) -> np.ndarray:
    """Exactly n words per row: zeros are added, further words left out."""
    return np.pad(words[:, :n], ((0, 0), (0, max(n - words.shape[1], 0))))
