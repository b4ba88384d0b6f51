"""Standing tables of the queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..operators.grid import Shape
from ..operators.learn import fit
from ..operators.score import score_wide
from ..session import cut, spread
from ..sources.vectors import samples_from_vectors
from .features import Member, build_features

SHAPE = Shape(8, 8)
RGB_SHAPE = Shape(5, 5, 3)

BASE_SPECS = [
    ("id", "mnist", "lin"), ("id", "mnist", "exp"), ("rot90", "mnist", "sig"),
    ("avg2", "mnist", "sqrt"), ("id", "edge", "lin"), ("hflip", "range", "gamma"),
]
SLICES = 4
CORPUS = [
    Member(i * SLICES + s, x, c, e, 8, s, SLICES) for i, (x, c, e) in enumerate(BASE_SPECS) for s in range(SLICES)
]
PLAIN = [Member(0, "id", "mnist", "lin")]
TRIO = [Member(0, "id", "mnist", "lin"), Member(1, "rot90", "mnist", "exp"), Member(2, "avg2", "mnist", "sig")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_from_vectors(table(spark, sf_dir, "embeddings"))


def spread_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples, over all cores even if the table is one small file."""
    return samples_from_vectors(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


def rgb_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 values of a vector as three 5x5 planes, the last one filled up with zeros."""
    cells = RGB_SHAPE.size * RGB_SHAPE.planes
    return samples(spark, sf_dir).withColumn("px", F.concat("px", F.array_repeat(F.lit(0), F.lit(cells) - F.size("px"))))


def features(spark: SparkSession, sf_dir: str, members: list[Member] = PLAIN) -> DataFrame:
    return build_features(spread_samples(spark, sf_dir), members, SHAPE)


def corpus_members(spark: SparkSession) -> DataFrame:
    rows = [(m.member_id, m.spec, m.xform, m.channel, m.encoding, m.width, m.slice) for m in CORPUS]
    return spark.createDataFrame(
        rows, "member_id LONG, spec STRING, xform STRING, channel STRING, encoding STRING, width INT, slice INT")


def corpus_scores(spark: SparkSession, sf_dir: str, split: str | None = "eval") -> DataFrame:
    """Scores of the corpus members, learned by counting on the training rows."""
    f = cut(features(spark, sf_dir, CORPUS), "features")
    weights, offsets = fit(f)
    wanted = f if split is None else f.where(F.col("split") == split)
    scored = score_wide(wanted, weights, offsets)
    return scored if split is None else scored.drop("split")


# --- catalogue of archives, one per row of `part` ------------------------------
CAT_XFORMS = ["id", "hflip", "rot90", "rot22@avg4", "rot0@id", "rot45@spiral", "sft-u1", "colswap-1-4", "avg2", "warp"]
CAT_CHANNELS = ["mnist", "edge", "lbp", "R", "RG", "H", "range", "alpha"]
CAT_ENCODINGS = ["lin", "exp", "sig", "sqrt", "gamma", "inv-exp", "tri", "foo"]
CAT_WIDTHS = [8, 16, 32, 12]
CAT_TOKENS = [1, 1, 1, 3, -1]


def pick(values: list, index: Column, kind: str | None = None) -> Column:
    return const_array(values, kind)[index.cast("int")]


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue row per part: spec and bookkeeping fields read off the part's columns."""
    key, size, brand = F.col("p_partkey"), F.col("p_size"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    rows = p.select(
        key.alias("member_id"),
        pick(CAT_XFORMS, key % 10).alias("xform"),
        pick(CAT_CHANNELS, brand % 8).alias("channel"),
        pick(CAT_ENCODINGS, size % 8).alias("encoding"),
        pick(CAT_WIDTHS, F.when(size == 50, 3).otherwise(brand % 3), "int").alias("width"),
        (size % 4).cast("int").alias("slice"),
        (size + brand).cast("bigint").alias("seed"),
        (cents % 9973).alias("file_time"),
        F.concat(F.lit("archive-"), F.lpad(key.cast("string"), 8, "0"), F.lit(".scores")).alias("source_file"),
        ((cents * 31 + brand * 977) % 6000 / 100.0 + 40.0).alias("eval"),
        pick(CAT_TOKENS, F.when(size > 45, 4).when(size > 40, 3).otherwise(size % 3), "int").alias("majority"),
        F.when(F.col("p_type") == "PROMO", "bv").otherwise("proj").alias("kind"),
        F.when(size == 1, 0).otherwise(size * 1000).cast("bigint").alias("n_samples"),
        F.when(size == 2, 2000).otherwise(10).cast("int").alias("n_classes"),
        brand.alias("n_members"),
        (size % 7 + 9).cast("int").alias("version"),
        F.lit(196).alias("hidden"), F.when(size == 3, 5).otherwise(10).cast("int").alias("epochs"),
        F.lit(1).alias("vn"), F.lit(1).alias("hn"), F.lit(32).alias("bits"), F.lit(17).alias("precision"),
        F.lit("int32").alias("counter_type"), F.when(brand == 7, "double").otherwise("int64").alias("score_type"),
    )
    spec = F.concat_ws(":", "xform", "channel", F.concat("encoding", F.col("width").cast("string")))
    wrong = F.concat_ws(":", "xform", F.lit("mnist"), F.concat("encoding", F.col("width").cast("string")))
    return rows.withColumns({"spec": spec, "file_spec": F.when(F.col("n_members") == 3, wrong).otherwise(spec)})


def stored_features(spark: SparkSession, sf_dir: str, members: list[Member] = PLAIN) -> DataFrame:
    """Features written once: learning and scoring pass over them several times."""
    return cut(features(spark, sf_dir, members), "features")
