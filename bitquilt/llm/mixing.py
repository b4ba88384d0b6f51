"""Mixing sources to target weights: a repetition rate per source, whole copies plus one seeded draw per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from ..session import broadcast_limit, cut
from .common import SALTS, hex_number

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights by the order of the sources, share of all words, most repetitions of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def reshare(sources: DataFrame, budget: float, most: int = MOST) -> DataFrame:
    """Adds `target` to (source_size, weight): `budget` shared by weight, none above `most` sizes, the excess reshared.

    Each round sets the sources above their limit to it and shares what is left by weight among the others, until none
    is above; a round is one aggregate, its result two numbers.
    """
    limit = F.col("source_size") * F.lit(most)
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > limit
        row = sources.agg(
            F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, limit).otherwise(0)).alias("taken"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if row["full"] == full or not row["free"]:
            break
        full, level = row["full"], (budget - row["taken"]) / row["free"]
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight")))


def by_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join rows with the few columns of their source (null-safe); broadcast if counted to fit, else hot sources are salted."""
    match = F.col("_source").eqNullSafe(F.col("source"))
    if n_sources * 64 <= broadcast_limit(rows.sparkSession):
        return rows.join(F.broadcast(sources.withColumnRenamed("source", "_source")), match).drop("_source")
    left = rows.withColumn("_salt", F.pmod(F.col("draw"), F.lit(SALTS)))
    right = sources.withColumnRenamed("source", "_source").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, match & (F.col("_salt") == F.col("_salt2"))).drop("_source", "_salt", "_salt2")


def mix_plan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken, and the columns of `keep`.

    size: words of the text (null or empty: 0). Sources stand in code point order, a null source is one of its own and
    last; their weights repeat 5, 2, 1. rate = target / source_size of the source; copies = floor(rate) plus one if the
    draw, a hash of seed, id and text, falls below the fraction. Rows that repeat share one draw; so does a rerun.
    A source without words has target 0 and copies 0. Sources are aggregated before any join.
    """
    keep = keep or []
    draw = hex_number(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"), F.md5(F.col("text"))))
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw"), *[F.col(c).alias(f"_keep_{c}") for c in keep]), "sizes")
    totals = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighted = ranked.select("source", "source_size", weight.cast("bigint").alias("weight"))
    whole = totals.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    targets = reshare(weighted, SHARE * (whole["words"] or 0)).drop("weight")
    joined = by_source(sized, targets, whole["n"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + F.when(F.col("draw") / F.lit(float(1 << 48)) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    planned = joined.withColumn("rate", rate).withColumn("copies", copies.cast("bigint"))
    return planned.select(
        "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: the columns of `docs`, each row once per copy, and `mix_copy` (1, 2) last.

    If `docs` has a column of that name already, the new one gets underscores in front.
    """
    name = "mix_copy"
    while name in docs.columns:
        name = "_" + name
    shadow = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    planned = mix_plan(shadow, ["row"]).where(F.col("copies") > 0)
    return planned.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id::VARCHAR, md5(text))), 1, 12))::BIGINT AS draw FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
-- sources fill up in the order of limit by weight; the level is set by those that stay below
levels AS (
  SELECT source, (1.5 * (SELECT sum(source_size) FROM totals) - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level, 2 * source_size / weight AS own,
    row_number() OVER o AS place
  FROM weighted WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
cut AS (SELECT level FROM levels WHERE level <= own ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM cut) * weight)::DOUBLE AS target FROM weighted),
rated AS (SELECT s.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
planned AS (SELECT *, (floor(rate) + CASE WHEN draw / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
