"""Tables of intermediate results and what they leave on disk."""

import glob
import os

from pyspark.sql import functions as F

from bitquilt.session import FILE_CLEANUP, cut, discard


def shuffle_bytes(root: str) -> int:
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**/shuffle_*.data", recursive=True))


def local_root(spark) -> str:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()


def test_cut_leaves_no_shuffle_files(spark):
    spark.sparkContext._jvm.System.gc()
    root, setting = local_root(spark), spark.conf.get(FILE_CLEANUP, None)
    before = shuffle_bytes(root)
    rows = spark.range(200_000).withColumn("k", F.xxhash64("id")).repartition(8, "k")
    table = cut(rows.groupBy((F.col("id") % 1000).alias("g")).agg(F.max("k").alias("k")), "sums")
    assert shuffle_bytes(root) <= before
    assert table.count() == 1000
    assert spark.conf.get(FILE_CLEANUP, None) == setting
    discard(table)


def test_a_cut_table_can_be_made_twice_and_over_cached_rows(spark):
    rows = spark.range(10_000).groupBy((F.col("id") % 7).alias("g")).count().persist()
    first, second = cut(rows, "a"), cut(rows.repartition(3, "g"), "b")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) == sorted(map(tuple, rows.collect()))
    rows.unpersist()
    discard(first, second)
