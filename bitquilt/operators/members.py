"""Member specs, filters and planning on catalogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..names import (
    CHANNEL_ALIASES, CHANNELS, DATASET_ENCODING_ALIASES, ENCODING_ALIASES, ENCODING_SYNONYMS, ENCODINGS,
    GRAY_CHANNELS, NAMED_FILTERS, XFORM_ALIASES, XFORMS,
)
from ..session import cut, join_side
from .rank import global_rank


def parse_spec(df: DataFrame, spec: str = "spec", default_width: int = 8) -> DataFrame:
    """Split XFORM:CHANNEL:ENCODING[WIDTH] into columns, resolving encoding synonyms."""
    parts = F.split(F.col(spec), ":")
    token = F.lower(F.get(parts, F.lit(2)))
    suffix = F.regexp_extract(token, "(32|16|8)$", 1)
    stem = F.regexp_extract(token, "^(.*?)(32|16|8)?$", 1)
    name = stem
    for synonym, target in ENCODING_SYNONYMS.items():
        name = F.when(stem == synonym, F.lit(target)).otherwise(name)
    return df.withColumns({
        "xform": F.get(parts, F.lit(0)),
        "steps": F.split(F.get(parts, F.lit(0)), "@"),
        "channel": F.get(parts, F.lit(1)),
        "encoding": name,
        "width": F.when(suffix == "", F.lit(default_width)).otherwise(F.expr(f"try_cast(regexp_extract(lower(split({spec}, ':')[2]), '(32|16|8)$', 1) AS INT)")).cast("int"),
    })


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def none_of(parts: list[Column]) -> Column:
    return ~reduce(lambda a, b: a | b, parts) if parts else F.lit(True)


def label_match(include: list[str] = (), exclude: list[str] = (), spec: str = "spec") -> Column:
    """Case-insensitive substrings: includes OR together, any exclude drops."""
    def has(p: str) -> Column:
        return F.lower(F.col(spec)).contains(p.lower())

    return any_of([has(p) for p in include]) & none_of([has(p) for p in exclude])


def regex_match(include: list[str] = (), exclude: list[str] = (), spec: str = "spec") -> Column:
    def hit(p: str) -> Column:
        return F.col(spec).rlike(f"(?i){p}")

    return any_of([hit(p) for p in include]) & none_of([hit(p) for p in exclude])


def eval_match(op: str, value: Column | float, column: str = "eval") -> Column:
    e = F.col(column)
    return {
        "gt": lambda: e > value, "ge": lambda: e >= value, "lt": lambda: e < value, "le": lambda: e <= value,
        "eq": lambda: F.abs(e - value) < 0.001,
    }[op]()


def filter_members(
    df: DataFrame, *, include: list[str] = (), exclude: list[str] = (), regex: list[str] = (),
    regex_exclude: list[str] = (), named: list[str] = (), eval_gt: float | None = None,
) -> DataFrame:
    """All kinds AND together; inside a kind includes OR and any exclude drops."""
    keep = label_match(include, exclude) & regex_match([*regex, *[NAMED_FILTERS[n] for n in named]], regex_exclude)
    if eval_gt is not None:
        keep = keep & eval_match("gt", eval_gt)
    return df.where(keep)


def filter_eval_percentile(df: DataFrame, percent: float, op: str, column: str = "eval", key: str = "member_id") -> DataFrame:
    """Compare with element floor(n*p/100) (at most n-1) of the ascending evals."""
    ranked = global_rank(df, [F.col(column), F.col(key)], "_i")
    total = ranked.agg(F.count("*").alias("n")).select(
        F.least(F.floor(F.col("n") * float(percent) / 100.0), F.col("n") - 1)
    ).scalar()
    limit = ranked.where(F.col("_i") == total).select(column).scalar()
    return ranked.where(eval_match(op, limit, column)).drop("_i")


def first_of(df: DataFrame, column: str, order: str) -> Column:
    """Scalar: value of the first row in the order; one combined aggregate."""
    return df.agg(F.min_by(column, order)).scalar()


def filter_consistent(df: DataFrame, token: str = "majority", kind: str = "kind", order: str = "source_file") -> DataFrame:
    """Keep rows whose majority token and kind equal the first archive's; token -1 is exempt."""
    same_token = (F.col(token) == first_of(df, token, order)) | (F.col(token) == -1)
    return df.where(same_token & (F.col(kind) == first_of(df, kind, order)))


def fold_channels(df: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Three-plane channels fall back to the gray source; duplicates disappear."""
    folded = F.when(F.col(channel).isin(GRAY_CHANNELS), F.col(channel)).otherwise(F.lit("mnist"))
    return df.withColumn(channel, folded).select(*keys, channel).distinct()


def find_spec(df: DataFrame, wanted: DataFrame, key: str = "wanted") -> DataFrame:
    """Member of each wanted spec: an exact match, else the spec followed by digits.

    Both rules are equalities (on the spec and on the spec without its trailing
    digits), so the search is two hash joins, not a pattern per pair.
    """
    exact = df.select(F.col("spec").alias(key), "member_id", F.lit(0).alias("_rule"))
    stripped = df.where(F.col("spec").rlike("[0-9]$"))
    digits = F.length(F.regexp_extract("spec", "([0-9]+)$", 1))
    # "exp16" answers for "exp" and "exp1"
    cuts = F.transform(F.sequence(F.lit(1), digits), lambda n: F.substring(F.col("spec"), F.lit(1), F.length("spec") - n))
    near = stripped.select(F.explode(cuts).alias(key), "member_id", F.lit(1).alias("_rule"))
    found = exact.unionByName(near).join(wanted.select(key).distinct(), key)
    return found.groupBy(key).agg(F.min(F.struct("_rule", "member_id")).alias("_b")).select(
        key, F.col("_b.member_id").alias("member_id"))


def dedup_members(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in load order."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def plan_sweep(spark: SparkSession, xforms: list[str], channels: list[str], encodings: list[str], widths: list[int], slices: int = 1) -> DataFrame:
    """Every xform x channel x encoding x width x slice, in the stable order."""
    one = spark.range(1)
    rows = (
        one.select(F.explode(const_array(xforms)).alias("xform"))
        .withColumn("channel", F.explode(const_array(channels)))
        .withColumn("encoding", F.explode(const_array(encodings)))
        .withColumn("width", F.explode(const_array(widths)))
        .withColumn("slice", F.explode(const_array(range(slices))))
    )
    spec = F.concat_ws(":", "xform", "channel", F.concat("encoding", F.col("width").cast("string")))
    return rows.withColumn("spec", spec).orderBy("xform", "channel", "encoding", "width", "slice")


def _expand(token: str, table: dict[str, str], depth: int = 5) -> list[str]:
    tokens = [token]
    for _ in range(depth):
        grown = [e for t in tokens for e in table.get(t.lower(), t).split(",")]
        if grown == tokens:
            break
        tokens = grown
    return tokens


def expand_xforms(text: str) -> list[str]:
    """Aliases of a comma list; `a@b` with aliases on both sides gives every pair."""
    out: list[str] = []
    for token in _expand(text, XFORM_ALIASES) if "," not in text else [e for t in text.split(",") for e in _expand(t, XFORM_ALIASES)]:
        chains = [""]
        for side in token.split("@"):
            names = _expand(side, XFORM_ALIASES)
            chains = [f"{c}@{n}" if c else n for c in chains for n in names]
        out += chains
    return out


def alias_table(spark: SparkSession, kind: str, dataset: str | None = None) -> DataFrame:
    """Alias rows (name, expansion); data-set rows win over the shared ones."""
    tables = {"xform": XFORM_ALIASES, "channel": CHANNEL_ALIASES, "encoding": dict(ENCODING_ALIASES)}
    table = dict(tables[kind])
    if kind == "encoding" and dataset:
        table.update(DATASET_ENCODING_ALIASES.get(dataset, {}))
    rows = [(k, v.split(",")) for k, v in table.items()]
    return spark.createDataFrame(rows, "name STRING, expansion ARRAY<STRING>")


def expand_tokens(df: DataFrame, column: str, aliases: DataFrame, passes: int = 5) -> DataFrame:
    """Replace alias tokens by their expansion until nothing changes, order kept.

    `ord` is the path of positions, so the expanded list can be sorted back.
    """
    side = F.broadcast(aliases)  # the alias tables are fixed and short
    df = df.withColumn("ord", F.array(F.lit(0)))
    for _ in range(passes):
        joined = df.join(side, F.lower(F.col(column)) == F.col("name"), "left")
        parts = F.coalesce(F.col("expansion"), F.array(F.col(column)))
        rest = [c for c in df.columns if c not in (column, "ord")]
        df = joined.select(*rest, "ord", F.posexplode(parts).alias("_p", column)).select(
            *rest, column, F.concat("ord", F.array("_p")).alias("ord"))
    return df


def expand_chains(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Alias expansion of `a@b@c` chains: every combination of the sides' expansions.

    The expansion depends on the text alone, so each distinct text is expanded
    once and the result joined back; the list of texts is broadcast if it fits.
    """
    texts = df.select(F.col(column).alias("_text"), F.col(column).alias("_token")).distinct()
    whole = expand_tokens(texts, "_token", aliases).select("_text", "ord", F.split("_token", "@").alias("_sides"))
    sides = whole.select("_text", F.col("ord").alias("_chain"), F.posexplode("_sides").alias("side", "_token"))
    grown = expand_tokens(sides, "_token", aliases)
    lists = grown.groupBy("_text", "_chain", "side").agg(F.array_sort(F.collect_list(F.struct("ord", "_token"))).alias("_l"))
    per_chain = lists.groupBy("_text", "_chain").agg(
        F.array_sort(F.collect_list(F.struct("side", F.col("_l._token").alias("names")))).alias("_s"))
    chains = F.aggregate(
        F.col("_s.names"), F.array(F.lit("")),
        lambda acc, names: F.flatten(F.transform(acc, lambda a: F.transform(
            names, lambda n: F.when(a == "", n).otherwise(F.concat(a, F.lit("@"), n))))),
    )
    expanded = per_chain.groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("_chain", chains.alias("names")))).alias("_e"))
    expanded = cut(expanded.select(F.col("_text").alias(column), F.flatten(F.col("_e.names")).alias("_names")), "aliases")
    joined = join_side(df, expanded, [column], expanded.count(), 8192)
    rest = [c for c in df.columns if c != column]
    return joined.select(*rest, F.explode("_names").alias(column))


def member_expand(df: DataFrame, xforms: list[str]) -> DataFrame:
    """Distinct (channel, encoding, width) of a set, repeated for a list of xforms."""
    distinct = df.select("channel", "encoding", "width").distinct()
    named = distinct.withColumn("xform", F.explode(const_array(xforms)))
    return named.withColumn("spec", F.concat_ws(":", "xform", "channel", F.concat("encoding", F.col("width").cast("string"))))


def unknown_names(df: DataFrame) -> DataFrame:
    """Rows with an xform step, channel, encoding or width outside the known names."""
    bad_steps = F.size(F.array_except(F.split("xform", "@"), const_array(XFORMS))) > 0
    return df.select(
        "*",
        bad_steps.alias("bad_xform"), (~F.col("channel").isin(CHANNELS)).alias("bad_channel"),
        (~F.col("encoding").isin(ENCODINGS)).alias("bad_encoding"), (~F.col("width").isin(8, 16, 32)).alias("bad_width"),
    )


def unused_seeds(used: DataFrame, n: int) -> DataFrame:
    """The n smallest seeds from 0 on that no archive used; as many candidates as used seeds and n always suffice."""
    spark = used.sparkSession
    taken = used.select(F.col("seed").cast("bigint").alias("seed")).distinct()
    return spark.range(taken.count() + n).withColumnRenamed("id", "seed").join(taken, "seed", "left_anti").orderBy("seed").limit(n)


def resume_sweep(planned: DataFrame, done: DataFrame, key: str = "spec", force: bool = False) -> DataFrame:
    return planned if force else planned.join(done.select(key).distinct(), key, "left_anti")


def seed_sort(df: DataFrame, top: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc("eval"), F.asc("member_id"))
    return ordered.limit(top) if top else ordered


