"""Samples from tables and from fixed-length record files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import global_rank


def quantise(vector: Column, low: float = -0.6, span: float = 1.2) -> Column:
    """Float vector to bytes, clamped."""
    def byte(x: Column) -> Column:
        raw = F.floor((x.cast("double") - low) / span * 255)
        return F.least(F.greatest(raw, F.lit(0)), F.lit(255)).cast("int")

    return F.transform(vector, byte)


def samples_from_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", eval_every: int = 5) -> DataFrame:
    """(sample_id, split, label, px): one row per labelled vector, read with two or three columns."""
    split = F.when(F.col(key) % eval_every == 0, "eval").otherwise("train")
    return table.select(F.col(key).alias("sample_id"), split.alias("split"), "label", quantise(F.col(vector)).alias("px"))


def pixels(samples: DataFrame, width: int) -> DataFrame:
    """Long form: one row per cell.

    A grid is never empty; the outer form spares the emptiness test that would
    evaluate the array expression a second time.
    """
    rest = [c for c in samples.columns if c != "px"]
    long = samples.select(*rest, F.posexplode_outer("px").alias("pos", "v"))
    return long.withColumns({"y": F.floor(F.col("pos") / width).cast("int"), "x": F.col("pos") % width})


def split_samples(samples: DataFrame, train_n: int, eval_n: int, order: str = "sample_id") -> DataFrame:
    """Split by position: the first train_n rows, then eval_n, as far as there are rows."""
    ranked = global_rank(samples.drop("split"), [F.col(order)], "_i")
    split = F.when(F.col("_i") < train_n, "train").otherwise("eval")
    return ranked.where(F.col("_i") < train_n + eval_n).withColumn("split", split).drop("_i")


def sample_limit(samples: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """The first n samples (quick modes): a top-k, no full sort."""
    return samples.orderBy(order).limit(n)


def split_ratio_kept(samples: DataFrame, classes: list[int]) -> DataFrame:
    """Counts of a class-filtered split whose eval share is kept."""
    kept = F.col("label").isin(classes)
    sizes = samples.agg(F.count("*").alias("total"), F.count_if(F.col("split") == "eval").alias("eval_n"), F.count_if(kept).alias("kept_n"))
    raw = F.expr("eval_n * kept_n div total")
    new_eval = F.when((raw < 1) & (F.col("kept_n") >= 10), F.lit(1).cast("bigint")).otherwise(raw)
    return sizes.select("total", "eval_n", "kept_n", new_eval.alias("new_eval"), (F.col("kept_n") - new_eval).alias("new_train"))


def filter_classes(samples: DataFrame, wanted: list[int | str], names: list[str]) -> DataFrame:
    """Keep classes given by index or by case-insensitive name; an unknown name is an error."""
    index = {n.lower(): i for i, n in enumerate(names)}
    chosen = []
    for w in wanted:
        key = str(w).lower()
        if isinstance(w, int) or (key.isdigit() and key not in index):
            chosen.append(int(w))
        elif key in index:
            chosen.append(index[key])
        else:
            raise ValueError(f"unknown class {w!r}")
    return samples.where(F.col("label").isin(chosen))


def filter_train_only(samples: DataFrame, classes: list[int]) -> DataFrame:
    """Restrict training rows to classes, keep every eval row."""
    return samples.where((F.col("split") == "eval") | F.col("label").isin(classes))


def sample_shuffle(samples: DataFrame, seed: int) -> DataFrame:
    return samples.orderBy(F.xxhash64(F.lit(seed), "sample_id"), "sample_id")


def read_fixed_records(spark: SparkSession, path: str, value_bytes: int, split: str, planes: int = 1) -> DataFrame:
    """Fixed-length records of one label byte and `value_bytes` value bytes.

    Files are cut at record boundaries and read in parallel.
    """
    record = 1 + value_bytes
    raw = spark.sparkContext.binaryRecords(path, record).map(lambda b: (bytearray(b),)).toDF("rec BINARY")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            flat = np.frombuffer(b"".join(bytes(r) for r in batch["rec"]), dtype=np.uint8).reshape(-1, record)
            yield pd.DataFrame({"split": split, "label": flat[:, 0].astype(np.int32),
                                "px": list(flat[:, 1:].astype(np.int32))})

    return raw.mapInPandas(decode, "split STRING, label INT, px ARRAY<INT>")


def write_fixed_records(samples: DataFrame, path: str) -> None:
    """Label byte, value bytes and one closing line-feed byte per sample."""
    def byte(c: Column) -> Column:
        return F.lpad(F.hex(c), 2, "0")

    text = F.concat(byte(F.col("label")), F.concat_ws("", F.transform("px", byte)))
    samples.select(F.unhex(text).cast("string").alias("value")).write.text(path)
