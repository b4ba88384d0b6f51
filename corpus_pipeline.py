"""A corpus pipeline: each stage is one operator over everything the stage before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. Extra columns are carried along.
Stages that compare rows go by a key of their own, so rows without a doc_id and rows that share one are compared like
all others; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquilt.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from bitquilt.session import cut, discard

#: Texts whose best language has a lower cosine are like no language: five deviations of the noise between unrelated sums.
LEAST_SCORE = 5 / language_id.DIMENSIONS ** 0.5
#: Short texts have lower cosines with their own language: they stay from this share of the cosine expected at their length.
LEAST_SHARE = 1 / 3


def whole_row() -> Column:
    """All columns in one, under their own names: helper columns beside it clash with none of them."""
    return F.struct("*").alias("row")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents go that are null, have no letter, or are like no language."""
    profiles, totals = language_id.learn_sized(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict_languages(docs.select(whole_row(), "text"), profiles, keep=["row"], totals=totals)
    least = F.least(F.lit(LEAST_SCORE), F.col("expected") * LEAST_SHARE) if profiles else F.lit(0.0)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= least)
    # with nothing to learn from, nothing can be rejected but texts without letters
    return found.where(known if profiles else F.lit(True)).select("row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as (key, row): a unique BIGINT in the order of doc_id, as far as there is one, and all columns.

    A doc_id that one row has is its key. The other rows are numbered in the order of their content, next to the range
    of the ids; the first of the rows that share an id has that as its key. Only these rows are written once more.
    """
    rows = docs.select("doc_id", whole_row())
    named, single_key = rows.where(F.col("doc_id").isNotNull()), F.col("doc_id").alias("key")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    odd_ids = cut(ids.where(F.col("doc_id").isNull() | (F.col("rows") > 1)).select("doc_id"), "odd_ids")
    if odd_ids.isEmpty():
        return rows.select(single_key, "row")
    single = named.join(odd_ids, "doc_id", "left_anti").select(single_key, "row")
    shared = named.join(odd_ids, "doc_id", "left_semi")
    # equal rows are dealt out too: which of them comes first makes no difference
    dealt = shared.unionByName(rows.where(F.col("doc_id").isNull())).withColumns({"hash": F.xxhash64("row"), "place": F.monotonically_increasing_id()})
    sorted_ = dealt.repartitionByRange("hash", "place").sortWithinPartitions("hash", "place").drop("place")
    odd = cut(sorted_.withColumn("number", F.monotonically_increasing_id()), "odd_rows")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    numbers = odd.agg(F.max("number")).first()[0] + 1
    base = (most if most is not None else -1) + 1
    if base + numbers > 1 << 63:
        base = least - numbers
        if base < -(1 << 63):
            raise ValueError("no numbers are free outside the range of doc_id")
    first = odd.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    key = F.when(F.col("first"), F.col("doc_id")).otherwise(F.col("number") + F.lit(base).cast("bigint"))
    return single.unionByName(odd.join(first, "number", "left").select(key.alias("key"), "row"))


def by_key(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `keyed` whose key is not among the doc_id of `keys`."""
    gone = keys.select(F.col("doc_id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group that links hold together, the row with the smallest key stays."""
    rows = keyed(docs)
    groups = jaccard_join.jaccard_components(by_key(rows))
    return without(rows, groups.where(F.col("doc_id") != F.col("component_id")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: repeated passages are cut from all but the first row; what is then blank goes."""
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in others]).alias("row")
    rows = keyed(docs).select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"), row, F.col("row.text").isNull().alias("no_text"))
    found = suffix_dedup.remove_repeats(rows, keep_text=True, keep=["row", "no_text"])
    left = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    value = {c: F.col("row").getField(c) for c in others} | {"text": F.when(~F.col("no_text"), F.col("kept"))}
    if "n_chars" in others:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(value["n_chars"])
    return left.select(*[value[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows that hold a benchmark item go."""
    rows = keyed(docs)
    found = decontaminate.contaminated(by_key(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]
#: Languages, suffixes and hashes have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again, and goes when the next one is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
