"""Corpus tables: scores, configuration, manifests, member lists, models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import const_array
from ..operators.reports import pairs
from ..session import fits_broadcast


def write_scores(scores: DataFrame, path: str, buckets: int | None = None, files: int = 4) -> None:
    """One directory per member, or per member bucket for tens of thousands of members.

    Rows are placed by the directory key and a slice of the samples before
    writing: a directory gets a few files, and no task holds a whole member.
    """
    key = "member_id"
    if buckets:
        key = "member_bucket"
        scores = scores.withColumn(key, _bucket(buckets))
    slices = F.pmod(F.xxhash64("sample_id"), F.lit(files))
    scores.repartition(F.col(key), slices).write.mode("overwrite").partitionBy(key).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("member_id"), F.lit(buckets)).cast("int")


def scan_scores(spark: SparkSession, path: str, members: DataFrame, buckets: int | None = None) -> DataFrame:
    """Scores of the given members only.

    The member list is broadcast while it fits, and its keys then prune the
    directories before any of their files is opened.
    """
    key = "member_bucket" if buckets else "member_id"
    schema = spark.read.parquet(path).schema
    typed = T.StructType([T.StructField(f.name, T.LongType()) if f.name == "member_id" else f for f in schema])
    wanted = members.select("member_id").distinct()
    if buckets:
        wanted = wanted.withColumn(key, _bucket(buckets))
    fits = fits_broadcast(spark, members.count(), 16)
    keys = ["member_id"] if key == "member_id" else [key, "member_id"]
    return spark.read.schema(typed).parquet(path).join(wanted.hint("broadcast") if fits else wanted, keys, "left_semi")


def write_sample_index(scores: DataFrame, members: DataFrame, path: str) -> None:
    """samples, members and pairs tables; pairs clustered by (member_id, sample_id)."""
    scores.select("sample_id", "label").distinct().write.mode("overwrite").parquet(f"{path}/samples")
    members.select("member_id", F.col("spec").alias("name")).write.mode("overwrite").parquet(f"{path}/members")
    (
        pairs(scores).repartitionByRange("member_id", "sample_id").sortWithinPartitions("member_id", "sample_id")
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/pairs")
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """kept, changed, new or orphan for every name of two listings (name, ctime, size)."""
    o = old.select("name", F.col("ctime").alias("_oc"), F.col("size").alias("_os"))
    n = new.select("name", F.col("ctime").alias("_nc"), F.col("size").alias("_ns"))
    same = (F.col("_oc") == F.col("_nc")) & (F.col("_os") == F.col("_ns"))
    state = (
        F.when(F.col("_nc").isNull(), "orphan").when(F.col("_oc").isNull(), "new")
        .when(same, "kept").otherwise("changed")
    )
    return o.join(n, "name", "full").select("name", state.alias("state"))


def read_changed(spark: SparkSession, diff: DataFrame, root: str) -> DataFrame:
    """Rows of the changed and new entries only; kept entries are not opened."""
    # catalogue-sized: one name per entry
    names = [r["name"] for r in diff.where("state IN ('changed', 'new')").select("name").orderBy("name").collect()]
    if not names:
        return spark.read.parquet(root).limit(0)
    return spark.read.option("basePath", root).parquet(*[f"{root}/{n}" for n in names])


def corpus_config(archives: DataFrame) -> DataFrame:
    """The one configuration row of a corpus: that of its first archive."""
    fields = ["hidden", "epochs", "vn", "hn", "majority", "bits", "precision", "counter_type", "score_type"]
    first = archives.agg(F.min_by(F.struct(*fields), "source_file").alias("_c"), F.count("*").alias("n_archives"))
    return first.select(*[F.col(f"_c.{f}").alias(f) for f in fields], "n_archives")


def member_set_out(selected: DataFrame, config: DataFrame, evals: DataFrame, target: list[int]) -> DataFrame:
    """The selected members with the corpus configuration, target classes and eval as columns."""
    row = config.select(F.struct(*[c for c in config.columns if c != "n_archives"]).alias("_c")).scalar()
    acc = evals.select("acc").scalar()
    out = selected.select("member_id", "spec", row.alias("_c"), const_array(target).alias("target"), acc.alias("set_eval"))
    return out.select("member_id", "spec", "_c.hidden", "_c.epochs", "_c.majority",
                      F.concat_ws(",", F.transform("target", lambda t: t.cast("string"))).alias("target"), "set_eval")


def write_member_list(selected: DataFrame, path: str, header: list[str]) -> None:
    """Text list: comment lines, then one spec per line."""
    spark = selected.sparkSession
    head = spark.createDataFrame([(i, f"# {h}") for i, h in enumerate(header)], "ord LONG, value STRING")
    body = selected.select((F.col("member_id") + len(header)).alias("ord"), F.col("spec").alias("value"))
    head.unionByName(body).orderBy("ord").select("value").write.mode("overwrite").text(path)


def parse_member_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Specs of a member list: blank and comment lines go, the spec ends at the first blank."""
    text = F.trim(F.col(value))
    kept = lines.where((text != "") & ~text.startswith("#"))
    return kept.withColumn("spec", F.regexp_extract(F.trim(F.col(value)), r"^(\S+)", 1))


def resolve_member_list(specs: DataFrame, members: DataFrame) -> DataFrame:
    """Every listed spec with the flag whether the pool has it."""
    pool = members.select("spec").distinct().withColumn("found", F.lit(True))
    return specs.select("spec").distinct().join(pool, "spec", "left").select("spec", F.coalesce("found", F.lit(False)).alias("found"))


def write_model(path: str, members: DataFrame, weights: DataFrame, offsets: DataFrame, w0: DataFrame | None = None) -> None:
    members.write.mode("overwrite").parquet(f"{path}/members")
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    offsets.write.mode("overwrite").parquet(f"{path}/offsets")
    if w0 is not None:
        w0.write.mode("overwrite").parquet(f"{path}/w0")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("members", "weights", "offsets")}


def _fnv1a(text: pd.Series) -> pd.Series:
    raw = [t.encode() for t in text]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    block = np.zeros((len(raw), int(lengths.max(initial=0))), dtype=np.uint64)
    for i, r in enumerate(raw):
        block[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    # offset basis and prime of FNV-1a (fixed values)
    state = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    for j in range(block.shape[1]):
        state = np.where(j < lengths, (state ^ block[:, j]) * np.uint64(0x100000001B3), state)
    return pd.Series(state.view(np.int64))


def fnv_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """64-bit FNV-1a id of a name; a name that collides gets a suffix and a new id.

    The hash wraps at 64 bits, which BIGINT arithmetic refuses, so it runs in
    Arrow batches over the bytes of all names of a batch at once.
    """
    fnv = F.pandas_udf(_fnv1a, "bigint")
    first = names.select(column).distinct().withColumn("_id", fnv(F.col(column)))
    same = Window.partitionBy("_id").orderBy(column)  # a 64-bit id: groups of one, rarely two
    numbered = first.withColumn("_n", F.row_number().over(same))
    final = F.when(F.col("_n") > 1, F.concat(column, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(column))
    return numbered.select(column, fnv(final).alias("member_id"))
