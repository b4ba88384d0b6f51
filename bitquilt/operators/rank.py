"""Dense global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..session import cut


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given total order.

    Rows are range-partitioned, sorted where they are and written once; then
    each range only needs its start, the sum of the sizes before it. The driver
    sees one count per range, never rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range").orderBy(*order)
    stored = cut(ranged.withColumn("_at", F.row_number().over(within) - 1), "ranked")
    sizes = {r["_range"]: r["n"] for r in stored.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for r in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(r, 0)
    base = const_array(starts or [0], "bigint")[F.col("_range")]
    return stored.withColumn(out, base + F.col("_at")).drop("_range", "_at")


def value_at(df: DataFrame, value: str, index: Column, order: list[Column]) -> Column:
    """Scalar: `value` of the row with the given index in the order."""
    ranked = global_rank(df, order, "_i")
    return ranked.where(F.col("_i") == index).select(value).scalar()
