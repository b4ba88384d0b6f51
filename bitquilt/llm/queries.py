"""The registered queries of this subpackage and the SQL that some of them can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path
from . import chat_tree, collocations, decontaminate, jaccard_join, language_id, license_scan, mixing, spelling, suffix_dedup, token_counts, token_ids, topk, url_filter
from .common import hex_number

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}

#: Token budget of op10 and neighbours of op5.
TOKEN_BUDGET = 1024
NEIGHBOURS = 5


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query("op2_chat_tree", chat_tree.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -7L, 1L, 'assistant', :t", args={"t": tricky})
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    sequence, members = chat_tree.prefix_tree(given, vocabulary())
    return chat_tree.conversation_digests(sequence, members, vocabulary())


@query("op5_norm_topk", topk.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors, NEIGHBOURS)


@query("op6_mix_sources", mixing.SQL + "SELECT doc_id, size, source_size, target, rate, copies, size * copies AS taken FROM planned")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(read(spark, sf_dir, "documents"))


#: Captures and dated list entries made of the pages: seconds from a fixed day, drawn from ids and hosts.
START, YEAR = 1_700_000_000, 31_536_000


def captures_of(pages: DataFrame) -> DataFrame:
    drawn = hex_number(F.concat(F.lit("f"), F.col("page_id").cast("string")), 7)
    return pages.select("page_id", "url", (START + drawn % YEAR).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    steps = F.split(url_filter.path_of(url), "/")
    hosts = pages.select(url_filter.host_of(url).alias("host"), F.element_at(steps, 2).alias("folder")).where("host IS NOT NULL").distinct()
    n = hex_number(F.concat_ws("/", "host", "folder"), 7)
    drawn = hosts.withColumn("n", n).withColumn("h", hex_number(F.col("host"), 7))
    first = START + F.col("n") % 20_000_000

    def entry(name: str, pattern, at, action: str, when):
        return F.when(when, F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), at.cast("bigint").alias("at"), F.lit(action).alias("action")))

    host, n, h = F.col("host"), F.col("n"), F.col("h")
    own = START + h % 20_000_000
    parent = F.concat_ws(".", F.slice(F.split(host, r"\."), 2, 9))
    folder = F.concat_ws("/", host, F.col("folder"))
    rows = F.array_compact(F.array(
        entry("spam", host, own, "add", h % 3 == 0), entry("spam", host, own + 5_000_000, "remove", h % 6 == 0), entry("spam", host, own + 9_000_000, "add", h % 12 == 0),
        entry("adult", parent, own + 1_000, "add", (h % 4 == 1) & (F.size(F.split(host, r"\.")) > 2)), entry("adult", parent, own + 900_000, "remove", h % 8 == 1),
        entry("folders", folder, first, "add", n % 5 == 2), entry("folders", folder, first + 7_000_000, "remove", n % 10 == 2),
        entry("allow", host, own + 3_000_000, "add", h % 7 == 0),
    ))
    return drawn.select(F.explode(rows).alias("e")).select("e.*")


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1)), '\.+$', ''), '') AS host,
    string_split(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]*([^?#\s]*)', 1), '/') AS steps,
    1700000000 + ('0x' || substr(md5('f' || page_id), 1, 7))::BIGINT % 31536000 AS fetched_at FROM pages),
d AS (SELECT *, ('0x' || substr(md5(concat_ws('/', host, folder)), 1, 7))::BIGINT AS n, ('0x' || substr(md5(host), 1, 7))::BIGINT AS h,
    array_to_string(string_split(host, '.')[2:], '.') AS parent
  FROM (SELECT DISTINCT host, steps[2] AS folder FROM p WHERE host IS NOT NULL)),
e AS (SELECT 'spam' AS list, host AS pattern, 1700000000 + h % 20000000 AS at, true AS on FROM d WHERE h % 3 = 0
  UNION SELECT 'spam', host, 1700000000 + h % 20000000 + 5000000, false FROM d WHERE h % 6 = 0
  UNION SELECT 'spam', host, 1700000000 + h % 20000000 + 9000000, true FROM d WHERE h % 12 = 0
  UNION SELECT 'adult', parent, 1700000000 + h % 20000000 + 1000, true FROM d WHERE h % 4 = 1 AND len(string_split(host, '.')) > 2
  UNION SELECT 'adult', parent, 1700000000 + h % 20000000 + 900000, false FROM d WHERE h % 8 = 1
  UNION SELECT 'folders', concat_ws('/', host, folder), 1700000000 + n % 20000000, true FROM d WHERE n % 5 = 2
  UNION SELECT 'folders', concat_ws('/', host, folder), 1700000000 + n % 20000000 + 7000000, false FROM d WHERE n % 10 = 2
  UNION SELECT 'allow', host, 1700000000 + h % 20000000 + 3000000, true FROM d WHERE h % 7 = 0),
k AS (SELECT page_id, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, 1 + len(list_filter(steps, lambda s: s <> ''))), lambda i: host || '/' || array_to_string(list_filter(steps, lambda s: s <> '')[1:i], '/'))))) AS key
  FROM p WHERE host IS NOT NULL),
-- the last entry at or before the capture, an add before a remove of the same instant, tells the state of a list's pattern
state AS (SELECT p.page_id, e.list, e.pattern, arg_max(e.on, e.at * 2 + e.on::INT) AS active
  FROM k JOIN p ON k.page_id = p.page_id JOIN e ON e.pattern = k.key AND e.at <= p.fetched_at GROUP BY ALL),
hit AS (SELECT page_id, count(*) AS n_active, list_sort(list_distinct(list(list))) AS lists FROM state WHERE active GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched_at, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, []::VARCHAR[]) AS lists,
  coalesce(n_active, 0) > 0 AND NOT list_contains(coalesce(lists, []::VARCHAR[]), 'allow') AS blocked
FROM p LEFT JOIN hit ON p.page_id = hit.page_id
"""


@query("op7_url_filter", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.active_entries(captures_of(pages), entries_of(pages), allow=["allow"])


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict_languages(docs, profiles)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_token_prefixes")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_prefixes(read(spark, sf_dir, "documents"), vocabulary(), TOKEN_BUDGET)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_BUDGET).alias("over_limit"), "cut_chars")


@query("op4_decontaminate", decontaminate.SQL + "SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_max(start, (similarity, -start))::INT AS start FROM s WHERE similarity >= 0.8 GROUP BY doc_id, item_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


#: The id that closes each document of op11.
END_ID = 2


@query("op11_token_ids")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "token_ids")
    token_ids.write_token_ids(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, END_ID)
    return token_ids.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op13_collocations", collocations.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.altered_runs(read(spark, sf_dir, "documents"), shortest=spelling.LEAST_LENGTH)
    return spelling.spelling_variants(runs)
