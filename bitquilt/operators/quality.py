"""Checks of a corpus: catalogue rows, score tables and their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import CHANNELS, ENCODINGS
from .members import first_of, unknown_names

# accepted ranges and tolerances (fixed values)
MAX_SAMPLES, MAX_CLASSES, MAX_MEMBERS = 1_000_000, 1000, 10_000
SCORE_LIMIT = 1 << 40
EVAL_TOLERANCE = 1.0


def check_ranges(archives: DataFrame, versions: list[int]) -> DataFrame:
    return archives.select(
        "member_id",
        (~F.col("n_samples").between(1, MAX_SAMPLES)).alias("bad_samples"),
        (~F.col("n_classes").between(1, MAX_CLASSES)).alias("bad_classes"),
        (~F.col("n_members").between(1, MAX_MEMBERS)).alias("bad_members"),
        (~F.col("version").isin(versions)).alias("bad_version"),
    )


def check_names(archives: DataFrame) -> DataFrame:
    flagged = unknown_names(archives)
    return flagged.where("bad_xform OR bad_channel OR bad_encoding OR bad_width").select(
        "member_id", "bad_xform", "bad_channel", "bad_encoding", "bad_width")


def check_spec_match(archives: DataFrame) -> DataFrame:
    """Rows whose file name spec differs from the stored spec."""
    return archives.where(F.col("file_spec") != F.col("spec")).select("member_id", "spec", "file_spec")


def check_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    top = F.max(F.greatest(*[F.abs(F.col(c)) for c in columns]))
    return scores.groupBy("member_id").agg(top.alias("max_abs")).select(
        "member_id", "max_abs", (F.col("max_abs") == 0).alias("all_zero"), (F.col("max_abs") > SCORE_LIMIT).alias("too_large"))


def check_labels(samples: DataFrame, n_classes: int) -> DataFrame:
    return samples.agg(F.count("*").alias("n"), F.count_if(~F.col("label").between(0, n_classes - 1)).alias("bad_labels"))


def check_counts(scores: DataFrame, n_samples, n_classes: int) -> DataFrame:
    """Members whose long score row count is not samples x classes."""
    return scores.groupBy("member_id").agg(F.count("*").alias("n_rows")).select(
        "member_id", "n_rows", (F.col("n_rows") != n_samples * n_classes).alias("bad_count"))


def check_dup_specs(archives: DataFrame) -> DataFrame:
    return archives.groupBy("spec").agg(F.count("*").alias("n"), F.min("member_id").alias("first_id")).where("n > 1")


def check_dims(archives: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows that differ from the first archive in one of the columns."""
    flags = [(F.col(c) != first_of(archives, c, order)).alias(f"bad_{c}") for c in columns]
    flagged = archives.select("member_id", *flags)
    any_bad = F.lit(False)
    for c in columns:
        any_bad = any_bad | F.col(f"bad_{c}")
    return flagged.where(any_bad)


def check_eval(archives: DataFrame, accuracy: DataFrame, tolerance: float = EVAL_TOLERANCE) -> DataFrame:
    """Members whose stored eval is off the computed one: to be trained again."""
    joined = archives.join(accuracy.select("member_id", "acc"), "member_id")
    off = F.abs(F.col("eval") - F.col("acc"))
    return joined.where(off > tolerance).select("member_id", "spec", "eval", "acc")


def check_config(archives: DataFrame, config: dict[str, object]) -> DataFrame:
    """One flag per field that differs from the corpus configuration."""
    return archives.select("member_id", *[(F.col(k) != F.lit(v)).alias(f"bad_{k}") for k, v in config.items()])


def check_roundtrip(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows lost and rows gained between a written table and its read-back."""
    lost = written.exceptAll(read).agg(F.count("*").alias("lost"))
    gained = read.exceptAll(written).agg(F.count("*")).scalar()
    return lost.select("lost", gained.alias("gained"))


def check_summary(findings: DataFrame) -> DataFrame:
    """OK / WARN / ERROR by the worst severity (0, 1, 2) of every archive, with counts."""
    worst = findings.groupBy("member_id").agg(F.max("severity").alias("worst"))
    status = F.when(F.col("worst") == 0, "OK").when(F.col("worst") == 1, "WARN").otherwise("ERROR")
    return worst.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def severities(archives: DataFrame) -> DataFrame:
    """Findings of the catalogue checks: unknown names are errors, a spec mismatch a warning."""
    bad = (~F.col("channel").isin(CHANNELS)) | (~F.col("encoding").isin(ENCODINGS)) | (~F.col("width").isin(8, 16, 32))
    name = archives.select("member_id", F.when(bad, 2).otherwise(0).alias("severity"))
    spec = archives.select("member_id", F.when(F.col("file_spec") != F.col("spec"), 1).otherwise(0).alias("severity"))
    return name.unionByName(spec)
