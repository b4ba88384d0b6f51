"""Queries: catalogue filters, specs, aliases, planning, quality checks, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import const_array
from ..names import CHANNEL_ALIASES, ENCODING_ALIASES, XFORM_ALIASES, XFORMS
from ..operators import members as mb
from ..operators import quality as ql
from ..operators import score as sc
from ..session import new_table_path
from ..sources import corpus as cp
from ..sources import vectors as sv
from . import data
from .registry import cte, query

SPEC = "member_id, spec"


def _arch(spark, d):
    return data.archives(spark, d)


# --- filters ------------------------------------------------------------------------


@query("filter_member_label", f"""SELECT {SPEC} FROM c_arch WHERE (contains(lower(spec), 'rot') OR contains(lower(spec), ':lbp:'))
AND NOT (contains(lower(spec), 'tri') OR contains(lower(spec), 'spiral'))""")
def _(spark, d):
    return _arch(spark, d).where(mb.label_match(["ROT", ":lbp:"], ["tri", "Spiral"])).select("member_id", "spec")


@query("filter_member_label_exclude_only", f"SELECT {SPEC} FROM c_arch WHERE NOT contains(lower(spec), 'mnist')")
def _(spark, d):
    return _arch(spark, d).where(mb.label_match(exclude=["mnist"])).select("member_id", "spec")


@query("filter_member_regex", f"SELECT {SPEC} FROM c_arch WHERE regexp_matches(spec, '(?i)^(ID|hflip):') AND NOT regexp_matches(spec, '(?i)(8|16)$')")
def _(spark, d):
    return _arch(spark, d).where(mb.regex_match(["^(ID|hflip):"], ["(8|16)$"])).select("member_id", "spec")


@query("filter_combined", f"""SELECT {SPEC} FROM c_arch WHERE contains(lower(spec), 'id') AND NOT contains(lower(spec), 'foo')
AND regexp_matches(spec, '(?i):(mnist|edge):') AND eval > 60""")
def _(spark, d):
    return mb.filter_members(_arch(spark, d), include=["id"], exclude=["foo"], regex=[":(mnist|edge):"], eval_gt=60.0).select("member_id", "spec")


@query("filter_named", rf"SELECT {SPEC} FROM c_arch WHERE regexp_matches(spec, '(?i)\brot[0-9]+@(id|spiral|avg2|avg3|avg4):')")
def _(spark, d):
    return mb.filter_members(_arch(spark, d), named=["t1"]).select("member_id", "spec")


_ops = {"gt": "eval > 70", "ge": "eval >= 70", "lt": "eval < 70", "le": "eval <= 70", "eq": "abs(eval - 70) < 0.001"}


@query("filter_eval_abs", " UNION ALL ".join(f"SELECT '{op}' AS op, member_id, eval FROM c_arch WHERE {cond}" for op, cond in _ops.items()))
def _(spark, d):
    a = _arch(spark, d).select("member_id", "eval")
    tagged = F.array(*[F.when(mb.eval_match(op, 70.0), F.lit(op)) for op in _ops])
    return a.select(F.explode(tagged).alias("op"), "member_id", "eval").where("op IS NOT NULL")


@query("filter_eval_pct", """SELECT member_id, eval FROM c_arch WHERE eval >= (SELECT eval FROM (
SELECT eval, row_number() OVER (ORDER BY eval, member_id) - 1 AS i, count(*) OVER () AS n FROM c_arch)
WHERE i = least(CAST(floor(n * 80e0 / 100) AS BIGINT), n - 1))""")
def _(spark, d):
    return mb.filter_eval_percentile(_arch(spark, d).select("member_id", "eval"), 80, "ge")


@query("filter_consistent", """SELECT member_id, majority, kind FROM c_arch WHERE
(majority = (SELECT arg_min(majority, source_file) FROM c_arch) OR majority = -1) AND kind = (SELECT arg_min(kind, source_file) FROM c_arch)""")
def _(spark, d):
    return mb.filter_consistent(_arch(spark, d)).select("member_id", "majority", "kind")


# --- specs -----------------------------------------------------------------------------


@query("spec_fields", "SELECT DISTINCT 'channel' AS field, split_part(spec, ':', 2) AS value FROM c_arch UNION ALL SELECT DISTINCT 'encoding', split_part(spec, ':', 3) FROM c_arch")
def _(spark, d):
    parts = F.split("spec", ":")
    pairs = F.array(F.struct(F.lit("channel").alias("field"), parts[1].alias("value")), F.struct(F.lit("encoding").alias("field"), parts[2].alias("value")))
    return _arch(spark, d).select(F.inline(pairs)).distinct()


@query("spec_parse", r"""SELECT member_id, split_part(spec, ':', 1) AS xform, len(string_split(split_part(spec, ':', 1), '@')) AS n_steps,
 split_part(spec, ':', 2) AS channel,
 CASE WHEN name = 'triangle' THEN 'tri' WHEN name = 'mitte' THEN 'mid' ELSE name END AS encoding,
 CASE WHEN suffix = '' THEN 8 ELSE CAST(suffix AS INTEGER) END AS width FROM (
SELECT *, regexp_extract(split_part(spec, ':', 3), '(32|16|8)$', 1) AS suffix, regexp_replace(split_part(spec, ':', 3), '(32|16|8)$', '') AS name FROM (
SELECT member_id, replace(replace(spec, ':tri', ':triangle'), ':sqrt8', ':mitte') AS spec FROM c_arch))""")
def _(spark, d):
    a = _arch(spark, d).select("member_id", F.replace(F.replace("spec", F.lit(":tri"), F.lit(":triangle")), F.lit(":sqrt8"), F.lit(":mitte")).alias("spec"))
    return mb.parse_spec(a).select("member_id", "xform", F.size("steps").alias("n_steps"), "channel", "encoding", "width")


@query("spec_lookup", r"""SELECT wanted, coalesce(min(member_id) FILTER (rule = 0), min(member_id)) AS member_id FROM (
SELECT w.wanted, a.member_id, CASE WHEN a.spec = w.wanted THEN 0 ELSE 1 END AS rule
FROM (SELECT DISTINCT CASE WHEN width = 16 THEN spec ELSE regexp_replace(spec, '[0-9]+$', '') END AS wanted FROM c_arch) w
JOIN c_arch a ON a.spec = w.wanted OR (starts_with(a.spec, w.wanted) AND regexp_full_match(substr(a.spec, len(w.wanted) + 1), '[0-9]+'))) GROUP BY wanted""")
def _(spark, d):
    a = _arch(spark, d)
    wanted = a.select(F.when(F.col("width") == 16, F.col("spec")).otherwise(F.regexp_replace("spec", "[0-9]+$", "")).alias("wanted"))
    return mb.find_spec(a.select("member_id", "spec"), wanted)


@query("channel_fold", """SELECT DISTINCT xform, encoding, width, CASE WHEN channel IN ('mnist','edge','bin','lbp','dog','var','dir','range') THEN channel ELSE 'mnist' END AS channel FROM c_arch""")
def _(spark, d):
    return mb.fold_channels(_arch(spark, d), ["xform", "encoding", "width"])


@query("dedup_members", """SELECT member_id, seed, spec FROM (SELECT *, row_number() OVER (PARTITION BY seed, xform, channel, encoding, width, kind ORDER BY file_time, member_id) AS rn FROM c_arch) WHERE rn = 1""")
def _(spark, d):
    a = _arch(spark, d).select("member_id", "seed", "xform", "channel", "encoding", "width", "kind", "file_time", "spec")
    return mb.dedup_members(a, ["seed", "xform", "channel", "encoding", "width", "kind"], ["file_time", "member_id"]).select("member_id", "seed", "spec")


@query("member_expand", """SELECT channel, encoding, width, x.xform, x.xform || ':' || channel || ':' || encoding || width AS spec
FROM (SELECT DISTINCT channel, encoding, width FROM c_arch WHERE eval > 80), (SELECT unnest(['id', 'rot22@avg4', 'spiral']) AS xform) x""")
def _(spark, d):
    return mb.member_expand(_arch(spark, d).where("eval > 80"), ["id", "rot22@avg4", "spiral"])


@query("member_order", "SELECT member_id, row_number() OVER (ORDER BY file_time, seed, member_id, source_file) - 1 AS rank FROM c_arch")
def _(spark, d):
    from ..operators.rank import global_rank

    order = [F.col(c) for c in ("file_time", "seed", "member_id", "source_file")]
    return global_rank(_arch(spark, d).select("member_id", "file_time", "seed", "source_file"), order).select("member_id", "rank")


@query("seed_sort", "SELECT member_id, eval FROM c_arch ORDER BY eval DESC, member_id LIMIT 50")
def _(spark, d):
    return mb.seed_sort(_arch(spark, d).select("member_id", "eval"), 50)


@query("pool_minus", """SELECT member_id FROM c_arch WHERE member_id NOT IN (SELECT member_id FROM c_arch WHERE eval > 85) AND member_id NOT IN (SELECT member_id FROM c_arch WHERE kind = 'bv')""")
def _(spark, d):
    a = _arch(spark, d)
    used, locked = a.where("eval > 85").select("member_id"), a.where("kind = 'bv'").select("member_id")
    return a.select("member_id").join(used.union(locked), "member_id", "left_anti")


@query("union_corpora", """SELECT member_id, seed, spec, corpus FROM (SELECT *, row_number() OVER (PARTITION BY seed, spec ORDER BY corpus, member_id) AS rn FROM (
SELECT member_id, seed, spec, 'a' AS corpus FROM c_arch WHERE majority = 1 UNION ALL SELECT member_id, seed, spec, 'b' FROM c_arch WHERE kind = 'proj')) WHERE rn = 1""")
def _(spark, d):
    a = _arch(spark, d).select("member_id", "seed", "spec", "majority", "kind")
    both = a.where("majority = 1").withColumn("corpus", F.lit("a")).unionByName(a.where("kind = 'proj'").withColumn("corpus", F.lit("b")))
    return mb.dedup_members(both.select("member_id", "seed", "spec", "corpus"), ["seed", "spec"], ["corpus", "member_id"])


cte("c_fnv", """WITH RECURSIVE f(name, i, h) AS (
SELECT source_file, 0, 14695981039346656037::UBIGINT FROM c_arch UNION ALL
SELECT name, i + 1, CAST((xor(h, CAST(ascii(substr(name, i + 1, 1)) AS UBIGINT))::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)
FROM f WHERE i < len(name)) SELECT name, h FROM f WHERE i = len(name)""")


@query("member_ids", """SELECT name, CAST(CASE WHEN h >= 9223372036854775808::UBIGINT THEN CAST(h AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(h AS HUGEINT) END AS BIGINT) AS member_id FROM c_fnv""")
def _(spark, d):
    return cp.fnv_ids(_arch(spark, d).select(F.col("source_file").alias("name")))


# --- aliases and planning --------------------------------------------------------------------


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', {i}, '{e}')" for k, v in table.items() for i, e in enumerate(v.split(",")))


for _kind, _table in [("xform", XFORM_ALIASES), ("channel", CHANNEL_ALIASES), ("encoding", ENCODING_ALIASES)]:
    cte(f"c_alias_{_kind}", f"SELECT * FROM (VALUES {_values(_table)}) AS t(name, i, token)")


def _nested(kind: str, src: str, passes: int = 5) -> str:
    for _ in range(passes):
        src = f"(SELECT s.member_id, coalesce(a.token, s.token) AS token FROM {src} s LEFT JOIN c_alias_{kind} a ON a.name = lower(s.token))"
    return src


_CH_TOKENS = ["auge", "rgb", "601", "edge", "diff", "sweep-fashion"]
_EN_TOKENS = ["performance", "old", "exp", "best-mnist", "ey-s-2b"]
_XF_TOKENS = ["performance", "augmentation", "all-rot@filter-bv", "hflip", "sweep-fashion", "all-colswap@avg4"]


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("alias_channels", f"SELECT member_id, token AS channel FROM {_nested('channel', f'(SELECT member_id, {_list(_CH_TOKENS)}[member_id % 6 + 1] AS token FROM c_arch)')}")
def _(spark, d):
    a = _arch(spark, d).select("member_id", data.pick(_CH_TOKENS, F.col("member_id") % 6).alias("channel"))
    return mb.expand_tokens(a, "channel", mb.alias_table(spark, "channel")).select("member_id", "channel")


@query("alias_encodings", f"""SELECT x.member_id, CASE WHEN contains(x.token, ':') THEN x.token ELSE c.channel || ':' || x.token END AS token
FROM {_nested('encoding', f'(SELECT member_id, {_list(_EN_TOKENS)}[member_id % 5 + 1] AS token FROM c_arch)')} x
JOIN (SELECT unnest(['mnist', 'edge']) AS channel) c ON NOT contains(x.token, ':') OR c.channel = 'mnist'""")
def _(spark, d):
    a = _arch(spark, d).select("member_id", data.pick(_EN_TOKENS, F.col("member_id") % 5).alias("token"))
    tokens = mb.expand_tokens(a, "token", mb.alias_table(spark, "encoding")).select("member_id", "token")
    # a bare encoding applies to every active channel
    bare = F.transform(const_array(["mnist", "edge"]), lambda c: F.concat(c, F.lit(":"), "token"))
    return tokens.select("member_id", F.explode(F.when(F.col("token").contains(":"), F.array("token")).otherwise(bare)).alias("token"))


_xf_first = _nested("xform", f"(SELECT member_id, {_list(_XF_TOKENS)}[member_id % 6 + 1] AS token FROM c_arch)")
_xf_left = _nested("xform", "(SELECT member_id, split_part(chain, '@', 1) AS token, chain FROM c_xf_chains)").replace("SELECT s.member_id,", "SELECT s.member_id, s.chain,")
_xf_right = _nested("xform", "(SELECT member_id, split_part(chain, '@', 2) AS token, chain FROM c_xf_chains)").replace("SELECT s.member_id,", "SELECT s.member_id, s.chain,")
cte("c_xf_chains", f"SELECT member_id, token AS chain FROM {_xf_first}")


@query("alias_xforms", f"""SELECT l.member_id, CASE WHEN r.token = '' THEN l.token ELSE l.token || '@' || r.token END AS xform
FROM {_xf_left} l JOIN {_xf_right} r ON r.member_id = l.member_id AND r.chain = l.chain""")
def _(spark, d):
    a = _arch(spark, d).select("member_id", data.pick(_XF_TOKENS, F.col("member_id") % 6).alias("xform"))
    return mb.expand_chains(a, "xform", mb.alias_table(spark, "xform"))


@query("plan_sweep", """SELECT a.xform, a.channel, a.encoding, a.width, s.slice, a.xform || ':' || a.channel || ':' || a.encoding || a.width AS spec
FROM (SELECT DISTINCT x.xform, c.channel, e.encoding, w.width FROM (SELECT DISTINCT xform FROM c_arch) x, (SELECT DISTINCT channel FROM c_arch) c,
(SELECT DISTINCT encoding FROM c_arch) e, (SELECT DISTINCT width FROM c_arch) w) a, (SELECT CAST(unnest(range(2)) AS INTEGER) AS slice) s""")
def _(spark, d):
    a = _arch(spark, d)
    # the names in use: a few per column, whatever the number of archives
    names = a.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("xform", "channel", "encoding", "width")]).first()
    return mb.plan_sweep(spark, names["xform"], names["channel"], names["encoding"], names["width"], 2)


@query("sweep_resume", """SELECT DISTINCT spec FROM (SELECT x.xform || ':mnist:' || e.encoding || '8' AS spec FROM (SELECT DISTINCT xform FROM c_arch) x, (SELECT DISTINCT encoding FROM c_arch) e)
WHERE spec NOT IN (SELECT spec FROM c_arch)""")
def _(spark, d):
    a = _arch(spark, d)
    names = a.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("xform", "encoding")]).first()
    planned = mb.plan_sweep(spark, names["xform"], ["mnist"], names["encoding"], [8]).select("spec")
    return mb.resume_sweep(planned, a)


@query("unused_seeds", "SELECT s.seed FROM (SELECT CAST(unnest(range((SELECT count(*) FROM c_arch) + 20)) AS BIGINT) AS seed) s WHERE s.seed NOT IN (SELECT seed FROM c_arch) ORDER BY s.seed LIMIT 20")
def _(spark, d):
    return mb.unused_seeds(_arch(spark, d), 20)


# --- quality checks --------------------------------------------------------------------------------


@query("check_ranges", """SELECT member_id, NOT (n_samples BETWEEN 1 AND 1000000) AS bad_samples, NOT (n_classes BETWEEN 1 AND 1000) AS bad_classes,
NOT (n_members BETWEEN 1 AND 10000) AS bad_members, version NOT IN (9, 10, 11, 12, 13, 14) AS bad_version FROM c_arch""")
def _(spark, d):
    return ql.check_ranges(_arch(spark, d), [9, 10, 11, 12, 13, 14])


@query("check_names", f"""SELECT * FROM (SELECT member_id, list_bool_or(bad) AS bad_xform, channel NOT IN ('mnist','edge','lbp','R','RG','H','range') AS bad_channel,
encoding = 'foo' AS bad_encoding, width = 12 AS bad_width FROM (
SELECT member_id, channel, encoding, width, [xform = 'warp'] AS bad FROM c_arch)) WHERE bad_xform OR bad_channel OR bad_encoding OR bad_width""".replace("list_bool_or(bad)", "bad[1]"))
def _(spark, d):
    assert "warp" not in XFORMS
    return ql.check_names(_arch(spark, d))


@query("check_spec_match", "SELECT member_id, spec, file_spec FROM c_arch WHERE spec <> file_spec")
def _(spark, d):
    return ql.check_spec_match(_arch(spark, d))


@query("check_dup_specs", "SELECT spec, count(*) AS n, min(member_id) AS first_id FROM c_arch GROUP BY spec HAVING count(*) > 1")
def _(spark, d):
    return ql.check_dup_specs(_arch(spark, d))


_dims = ["n_classes", "kind", "epochs"]


@query("check_dims", "SELECT * FROM (SELECT member_id, " + ", ".join(
    f"{c} <> (SELECT arg_min({c}, source_file) FROM c_arch) AS bad_{c}" for c in _dims) + " FROM c_arch) WHERE " + " OR ".join(f"bad_{c}" for c in _dims))
def _(spark, d):
    return ql.check_dims(_arch(spark, d), _dims, "source_file")


_config = {"hidden": 196, "epochs": 10, "vn": 1, "hn": 1, "majority": 1, "bits": 32, "precision": 17, "counter_type": "int32", "score_type": "int64"}


@query("check_config", "SELECT member_id, " + ", ".join(f"{k} <> {v!r} AS bad_{k}" for k, v in _config.items()) + " FROM c_arch")
def _(spark, d):
    return ql.check_config(_arch(spark, d), _config)


@query("check_summary", """SELECT CASE WHEN worst = 0 THEN 'OK' WHEN worst = 1 THEN 'WARN' ELSE 'ERROR' END AS status, count(*) AS n FROM (
SELECT CASE WHEN channel = 'alpha' OR encoding = 'foo' OR width = 12 THEN 2 WHEN spec <> file_spec THEN 1 ELSE 0 END AS worst FROM c_arch) GROUP BY ALL""")
def _(spark, d):
    return ql.check_summary(ql.severities(_arch(spark, d)))


@query("check_labels", "SELECT count(*) AS n, count(*) FILTER (label NOT BETWEEN 0 AND 8) AS bad_labels FROM c_samples")
def _(spark, d):
    return ql.check_labels(data.samples(spark, d), 9)


@query("check_scores", """SELECT member_id, max(abs(score)) AS max_abs, max(abs(score)) = 0 AS all_zero, max(abs(score)) > 1099511627776 AS too_large FROM c_fact GROUP BY member_id""")
def _(spark, d):
    return ql.check_scores(data.corpus_scores(spark, d), sc.class_columns())


@query("check_counts", """SELECT member_id, count(*) AS n_rows, count(*) <> (SELECT count(*) FROM c_samples WHERE split = 'eval') * 10 AS bad_count
FROM c_fact WHERE member_id <> 3 OR score > 0 GROUP BY member_id""")
def _(spark, d):
    n = data.samples(spark, d).where("split = 'eval'").agg(F.count("*")).scalar()
    rows = sc.long(data.corpus_scores(spark, d), ["member_id", "sample_id"])
    return ql.check_counts(rows.where("member_id <> 3 OR score > 0"), n, 10)


@query("check_eval", """SELECT a.member_id, a.spec, a.eval, p.acc FROM c_arch a JOIN (
SELECT member_id, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM c_pred GROUP BY member_id) p ON p.member_id = a.member_id WHERE abs(a.eval - p.acc) > 1""")
def _(spark, d):
    acc = sc.accuracy(sc.predictions(data.corpus_scores(spark, d)), ["member_id"])
    return ql.check_eval(_arch(spark, d), acc)


@query("check_roundtrip", "SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained FROM embeddings LIMIT 1")
def _(spark, d):
    scores = data.corpus_scores(spark, d)
    path = new_table_path(spark, "roundtrip")
    cp.write_scores(scores, path)
    back = spark.read.schema(scores.schema).parquet(path).select(*scores.columns)
    return ql.check_roundtrip(scores, back)


# --- manifests, configuration, lists -----------------------------------------------------------------


@query("manifest_diff", """SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN 'orphan' WHEN o.name IS NULL THEN 'new'
WHEN o.ctime = n.ctime AND o.size = n.size THEN 'kept' ELSE 'changed' END AS state
FROM (SELECT source_file AS name, file_time AS ctime, n_samples AS size FROM c_arch WHERE seed > 12) o
FULL JOIN (SELECT source_file AS name, CASE WHEN kind = 'bv' THEN file_time + 1 ELSE file_time END AS ctime, n_samples + epochs - 10 AS size FROM c_arch WHERE seed < 60) n ON n.name = o.name""")
def _(spark, d):
    a = _arch(spark, d)
    old = a.where("seed > 12").selectExpr("source_file AS name", "file_time AS ctime", "n_samples AS size")
    new = a.where("seed < 60").selectExpr("source_file AS name", "IF(kind = 'bv', file_time + 1, file_time) AS ctime", "n_samples + epochs - 10 AS size")
    return cp.manifest_diff(old, new)


@query("corpus_config", """SELECT hidden, epochs, vn, hn, majority, bits, precision, counter_type, score_type, (SELECT count(*) FROM c_arch) AS n_archives
FROM c_arch ORDER BY source_file LIMIT 1""")
def _(spark, d):
    return cp.corpus_config(_arch(spark, d))


@query("member_list_in", """SELECT DISTINCT spec, spec IN (SELECT spec FROM c_arch WHERE kind = 'proj') AS found FROM (
SELECT split_part(trim(line), ' ', 1) AS spec FROM (SELECT CASE WHEN majority = 3 THEN '# ' || spec WHEN majority = -1 THEN '  ' ELSE ' ' || spec || '  0xBDD73226' END AS line FROM c_arch)
WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))""")
def _(spark, d):
    a = _arch(spark, d)
    line = F.when(F.col("majority") == 3, F.concat(F.lit("# "), "spec")).when(F.col("majority") == -1, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), "spec", F.lit("  0xBDD73226")))
    path = new_table_path(spark, "list")
    a.select(line.alias("value")).write.text(path)
    return cp.resolve_member_list(cp.parse_member_list(spark.read.text(path)), a.where("kind = 'proj'"))


@query("member_set_out", """SELECT m.member_id, m.spec, c.hidden, c.epochs, c.majority, '1,3' AS target, e.acc AS set_eval FROM c_members m,
(SELECT hidden, epochs, majority FROM c_arch ORDER BY source_file LIMIT 1) c,
(SELECT count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM (SELECT sample_id, label, arg_max(class_id, s * 16 - class_id) AS pred FROM (
 SELECT sample_id, label, class_id, CAST(sum(score) AS BIGINT) AS s FROM c_fact WHERE member_id IN (0, 5, 9) GROUP BY ALL) GROUP BY ALL)) e
WHERE m.member_id IN (0, 5, 9)""")
def _(spark, d):
    chosen = data.corpus_members(spark).where("member_id IN (0, 5, 9)")
    sums = sc.ensemble_sum(data.corpus_scores(spark, d).where("member_id IN (0, 5, 9)"), ["sample_id", "label"])
    return cp.member_set_out(chosen, cp.corpus_config(_arch(spark, d)), sc.accuracy(sc.predictions(sums), []), [1, 3])


@query("sink_member_list", "SELECT spec FROM c_arch WHERE eval > 90")
def _(spark, d):
    path = new_table_path(spark, "list")
    cp.write_member_list(_arch(spark, d).where("eval > 90"), path, ["Optimal subset: XF:CHAN:ENC", "META: H=196  EP=10"])
    return cp.parse_member_list(spark.read.text(path)).select("spec")


# --- sources and sinks of the score tables -----------------------------------------------------------


@query("src_fixed_records", "SELECT 'train' AS split, s.label, array_to_string(list(p.v ORDER BY p.pos), ',') AS px FROM c_samples s JOIN c_px p USING (sample_id) GROUP BY s.sample_id, s.label")
def _(spark, d):
    """Samples written as records of a label byte, 64 values and an end byte, then read back."""
    path = new_table_path(spark, "records")
    sv.write_fixed_records(data.samples(spark, d), path)
    back = sv.read_fixed_records(spark, path, 65, "train")
    return back.select("split", "label", F.array_join(F.slice("px", 1, 64), ",").alias("px"))


@query("sink_scores", "SELECT member_id, sample_id, class_id, score FROM c_fact")
def _(spark, d):
    path = new_table_path(spark, "scores")
    cp.write_scores(data.corpus_scores(spark, d), path)
    return sc.long(spark.read.parquet(path), ["member_id", "sample_id"])


@query("scan_scores_pruned", "SELECT member_id, sample_id, class_id, score FROM c_fact WHERE member_id IN (SELECT member_id FROM c_members WHERE contains(spec, 'rot90'))")
def _(spark, d):
    path = new_table_path(spark, "scores")
    cp.write_scores(data.corpus_scores(spark, d), path)
    wanted = data.corpus_members(spark).where(mb.label_match(["rot90"]))
    return sc.long(cp.scan_scores(spark, path, wanted), ["member_id", "sample_id"])


@query("scan_scores_bucketed", "SELECT member_id, sample_id, class_id, score FROM c_fact WHERE member_id IN (SELECT member_id FROM c_members WHERE contains(spec, 'edge'))")
def _(spark, d):
    path = new_table_path(spark, "scores")
    cp.write_scores(data.corpus_scores(spark, d), path, buckets=8)
    wanted = data.corpus_members(spark).where(mb.label_match(["edge"]))
    return sc.long(cp.scan_scores(spark, path, wanted, buckets=8), ["member_id", "sample_id"])


@query("sink_sample_index", "SELECT member_id, sample_id, pred, margin FROM c_pred")
def _(spark, d):
    path = new_table_path(spark, "index")
    cp.write_sample_index(data.corpus_scores(spark, d), data.corpus_members(spark), path)
    return spark.read.parquet(f"{path}/pairs")
