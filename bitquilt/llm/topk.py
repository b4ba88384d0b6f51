"""Exact top-k inner products with buckets of similar length (norm) and per-bucket pruning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_side

#: Vectors of a candidate block, and queries of a query block.
BLOCK_ROWS = 2048
QUERY_ROWS = 256
#: From this local cosine threshold on, single coordinates decide; below it, lengths do.
COORDINATE_FROM = 0.3
COORDINATES = 4
#: Vectors that meet the queries of a block in one matrix product.
STRIP_ROWS = 512
#: Blocks of a group, on average.
VECTOR_BLOCKS, QUERY_BLOCKS = 4, 32
#: Of a row that tells a block's cell.
LABEL_BYTES = 64


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; null vectors, and those with a null, NaN or infinite one, go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fit = F.col(vector).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    return rows.where(fit & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).cast("array<double>").alias("v"))


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Pack vectors into blocks of `size` rows by falling length: dims, block, ids, values, longest.

    Rows are range-partitioned by (dimension, length); a block never crosses a range, so none is gathered in one task.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    sized = rows.select("vec_id", "v", F.size("v").alias("dims"), length.alias("norm"))
    ranged = sized.repartitionByRange("dims", F.col("norm").desc(), "vec_id").withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_range", "dims").orderBy(F.col("norm").desc(), "vec_id")) - 1
    packed = ranged.withColumn("_block", F.floor(place / size)).groupBy("_range", "dims", "_block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("norm")).alias("order"), "vec_id", "v"))).alias("rows"), F.max("norm").alias("longest"))
    return cut(packed.select(
        "dims", F.concat_ws("-", "dims", "_range", "_block").alias("block"), F.transform("rows", lambda r: r["vec_id"]).alias("ids"),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias("values"), "longest"), name)


class Blocks(NamedTuple):
    """n blocks of a table, dealt to groups."""

    rows: DataFrame
    n: int
    groups: int


def grouped(packed: DataFrame, block: str, size: int, name: str) -> Blocks:
    """Deal the blocks to groups of `size` blocks on average."""
    n = packed.count()
    groups = max(1, -(-n // size))
    return Blocks(packed.withColumn(name, F.pmod(F.xxhash64(block), F.lit(groups))), n, groups)


def best_k(k: int, at: np.ndarray, ids: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k largest products of each query (numbered by `at`), ties to the smaller id: by query, the largest first; and their ranks from 0."""
    order = np.lexsort((ids, -products, at))
    at = at[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    few = rank < k
    return at[few], ids[order][few], products[order][few], rank[few]


def by_coordinates(q: np.ndarray, top: np.ndarray, rest: float, vectors: np.ndarray, norms: np.ndarray, bound: float) -> np.ndarray:
    """Rows that can reach the bound: the largest coordinates of q exactly, the rest by their lengths."""
    part = vectors[:, top]
    rest_v = np.sqrt(np.maximum(norms ** 2 - (part * part).sum(axis=1), 0.0))
    return np.flatnonzero(part @ q[top] + rest * rest_v >= bound)


def best_of(queries: np.ndarray, query_ids: np.ndarray, candidates: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query, vector, product) of the k best of all candidate blocks (ids, vectors) for each query, ties to the smaller id.

    floor: per query, a product that k vectors are known to reach; what stays below it is left out, and it rises with
    what the blocks hold. The vectors of a block stand by falling length. The local threshold floor / (|q| * longest) says
    which test each query uses. Coordinates are only tested where the rest of q alone cannot reach the bound: else they
    rule out no vector without a share in them. All other queries meet a strip of vectors in one matrix product.
    """
    floor = floor.copy()
    lengths = np.sqrt((queries * queries).sum(axis=1))
    top = np.argsort(-np.abs(queries), axis=1)[:, :COORDINATES]
    rest = np.sqrt(np.maximum(lengths ** 2 - (np.take_along_axis(queries, top, axis=1) ** 2).sum(axis=1), 0.0))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def add(at: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        use = (products >= floor[at]) & (ids != query_ids[at])
        found.append((at[use], ids[use], products[use]))

    def keep_best() -> None:
        at, ids, products, rank = best_k(k, *(np.concatenate(x) for x in zip(*found, strict=True)))
        found[:] = [(at, ids, products)]
        full = rank == k - 1
        floor[at[full]] = np.maximum(floor[at[full]], products[full])

    for ids, vectors in candidates:
        if not len(ids) or not len(queries):
            continue
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        bound = floor - 1e-6 * np.maximum(1.0, np.abs(np.nan_to_num(floor, neginf=0.0)))
        # length pruning: |q| * |v| must reach the bound
        with np.errstate(divide="ignore"):
            reach = np.searchsorted(-norms, -bound / lengths, "right")
        local = np.divide(floor, lengths * norms[0], out=np.zeros(len(floor)), where=(floor > 0) & (lengths * norms[0] > 0))
        focused = (reach > 0) & (local >= COORDINATE_FROM) & (rest < local * lengths)
        for i in np.flatnonzero(focused):
            rows = by_coordinates(queries[i], top[i], rest[i], vectors[:reach[i]], norms[:reach[i]], bound[i])
            add(np.full(len(rows), i), ids[rows], vectors[rows] @ queries[i])
        open_ = np.flatnonzero(~focused & (reach > 0))
        # whole numbers and their sums are exact in 32-bit floats below 2^24
        kind = np.float32 if norms[0] * lengths.max() < 1 << 24 else np.float64
        asking = queries.astype(kind)
        for start in range(0, reach[open_].max(initial=0), STRIP_ROWS):
            at = open_[reach[open_] > start]
            products = asking[at] @ vectors[start:start + STRIP_ROWS].astype(kind).T
            q, v = np.divmod(np.flatnonzero(products >= floor[at].astype(kind)[:, None]), products.shape[1])
            add(at[q], ids[start + v], products[q, v].astype(np.float64))
            if sum(len(x[0]) for x in found) > 8 * k * len(queries):
                keep_best()
        keep_best()
    at, ids, products = found[0]
    return query_ids[at], ids, products


PAIR = "query_id bigint, vec_id bigint, score bigint"
CELL = ["dims", "q_group", "group"]


def cells(meetings: DataFrame, asked: Blocks, stored: Blocks) -> DataFrame:
    """The blocks of each cell (a group of query blocks and a group of vector blocks, of which some meet).

    So a block travels once per group of the other side, not once per block that it meets.
    """
    met = [meetings.select(*CELL, b).distinct() for b in ("block", "q_block")]
    vectors = join_side(stored.rows.drop(*CELL), met[0], ["block"], stored.n * asked.groups, LABEL_BYTES)
    queries = join_side(asked.rows.drop(*CELL), met[1], ["q_block"], asked.n * stored.groups, LABEL_BYTES)
    return vectors.select(*CELL, F.lit(False).alias("asks"), "longest", "ids", "values", F.lit(None).cast("array<double>").alias("floors")).union(
        queries.select(*CELL, F.lit(True), "q_longest", "q_ids", "q_values", "floors"))


def search_cells(found: DataFrame, k: int) -> DataFrame:
    """The best of each query block in each cell. A task keeps the vectors of one cell, the query blocks pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, candidates = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                own = tuple(batch.column(c)[r].as_py() for c in CELL)
                if own != cell:
                    cell, candidates = own, []
                ids = get("ids")
                rows = get("values").reshape(len(ids), max(own[0], 0))
                if not batch.column("asks")[r].as_py():
                    candidates.append((ids, rows))
                    continue
                query_ids, vec_ids, products = best_of(rows, ids, candidates, k, get("floors"))
                # a product beyond 64 bits is an error, not another number
                yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(vec_ids), pa.array(products).cast(pa.int64())], names=["query_id", "vec_id", "score"])

    # the vectors of a cell come first, the longest of them at the top
    return found.repartition(*CELL).sortWithinPartitions(*CELL, "asks", F.col("longest").desc()).drop("longest").mapInArrow(run, PAIR)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k largest inner products of each query with the other vectors: query_id, rank, vec_id, score.

    queries and vectors: (vec_id, v) with whole-numbered components. Ties go to the smaller vec_id; a query is no
    candidate of its own id; only vectors of the same dimension meet; fewer than k candidates give fewer rows. Repeated
    ids count once (their vectors must then be equal). The longest block of each dimension sets a floor per query; then
    each pair of blocks that lengths alone don't rule out is searched, many pairs in a cell of two groups of blocks.
    """
    once = lambda rows: rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    stored = grouped(blocks(once(vectors), BLOCK_ROWS, "vectors"), "block", VECTOR_BLOCKS, "group")
    asked = grouped(blocks(once(queries), QUERY_ROWS, "queries").select(
        "dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.col("longest").alias("q_longest")), "q_block", QUERY_BLOCKS, "q_group")
    first = stored.rows.groupBy("dims").agg(F.max_by(F.struct("group", "block"), F.struct("longest", "block")).alias("first")).select("dims", "first.*")
    open_floor = F.transform("q_ids", lambda _: F.lit(float("-inf")))
    start = search_cells(cells(asked.rows.select("dims", "q_group", "q_block").join(first, "dims"), asked._replace(rows=asked.rows.withColumn("floors", open_floor)), stored), k)
    reached = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    floors = asked.rows.select("q_block", F.posexplode("q_ids").alias("at", "query_id")).join(reached, "query_id", "left").groupBy("q_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))), lambda x: x["floor"]).alias("floors"))
    asked = asked._replace(rows=cut(asked.rows.join(floors, "q_block").withColumn("lowest", F.array_min("floors")), "asked"))
    # which blocks meet is decided on their labels; the vectors follow by equality
    meetings = asked.rows.select("dims", "q_group", "q_block", "q_longest", "lowest").join(
        stored.rows.select("dims", "group", "block", "longest"), "dims").where(F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("lowest"))
    return ranked(search_cells(cells(meetings, asked, stored), k), k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
