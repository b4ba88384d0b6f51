"""Queries: samples, encodings, words, projection, majority, grids, channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.colors import POINT_CHANNELS, color_channel, hue
from ..functions.encodings import encode
from ..functions.words import (
    explode_bits, explode_words, pack_array, popcount_similarity, split_groups, with_random_word, xnor,
)
from ..names import ENCODINGS, XFORMS
from ..operators import majority as mj
from ..operators import project as pj
from ..operators.grid import apply_xform
from ..operators.stencil import with_channel
from ..sources import vectors as sv
from . import data
from .features import build_features, row_members
from .registry import cte, query
from .sql import W, code, draws, grid_sql, register_learning, stencil_sql, words_sql

# --- samples ------------------------------------------------------------------


@query("samples_from_vectors", "SELECT s.sample_id, s.split, s.label, p.pos, p.v FROM c_samples s JOIN c_px p USING (sample_id)")
def _(spark, d):
    return sv.pixels(data.samples(spark, d), W).select("sample_id", "split", "label", "pos", "v")


@query("split_samples", """SELECT vec_id AS sample_id, label, CASE WHEN rn <= 400 THEN 'train' ELSE 'eval' END AS split
FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 400 + 1000000""")
def _(spark, d):
    return sv.split_samples(data.samples(spark, d).select("sample_id", "split", "label"), 400, 1_000_000)


@query("split_ratio_kept", """SELECT total, eval_n, kept_n, new_eval, kept_n - new_eval AS new_train FROM (
SELECT total, eval_n, kept_n, CASE WHEN eval_n * kept_n // total < 1 AND kept_n >= 10 THEN 1 ELSE eval_n * kept_n // total END AS new_eval FROM (
SELECT count(*) AS total, count(*) FILTER (split = 'eval') AS eval_n, count(*) FILTER (label IN (1, 3, 6)) AS kept_n FROM c_samples))""")
def _(spark, d):
    return sv.split_ratio_kept(data.samples(spark, d), [1, 3, 6])


@query("filter_classes", "SELECT sample_id, split, label FROM c_samples WHERE label IN (2, 6, 9)")
def _(spark, d):
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    return sv.filter_classes(data.samples(spark, d), ["TWO", 6, "9"], names).select("sample_id", "split", "label")


@query("filter_train_only", "SELECT sample_id, split, label FROM c_samples WHERE split = 'eval' OR label IN (0, 4)")
def _(spark, d):
    return sv.filter_train_only(data.samples(spark, d), [0, 4]).select("sample_id", "split", "label")


@query("sample_limit", "SELECT sample_id, split, label FROM c_samples ORDER BY sample_id LIMIT 100")
def _(spark, d):
    return sv.sample_limit(data.samples(spark, d).select("sample_id", "split", "label"), 100)


@query("sample_shuffle", "SELECT sample_id, split, label FROM c_samples")
def _(spark, d):
    return sv.sample_shuffle(data.samples(spark, d).select("sample_id", "split", "label"), 42)


@query("union_splits", "SELECT sample_id, label FROM c_samples WHERE split = 'train' UNION ALL SELECT sample_id, label FROM c_samples WHERE split = 'eval'")
def _(spark, d):
    s = data.samples(spark, d).select("sample_id", "label", "split")
    return s.where("split = 'train'").unionByName(s.where("split = 'eval'")).drop("split")


# --- encodings -------------------------------------------------------------------


def _encoding_query(name: str) -> None:
    @query(f"encode_{name.replace('-', '_')}", f"SELECT sample_id, pos, v, {code(name)} AS code FROM c_px")
    def _(spark, d):
        px = sv.pixels(data.samples(spark, d), W)
        return px.select("sample_id", "pos", "v", encode(F.col("v"), name, 8).alias("code"))


for _name in ENCODINGS:
    _encoding_query(_name)


ALL_CODES = [(e, m) for e in ENCODINGS for m in (8, 16, 32)]


def _code_name(e: str, m: int) -> str:
    return f"{e.replace('-', '_')}_{m}"


@query("encode_all", "SELECT sample_id, CAST(pos AS INTEGER) AS pos, " + ", ".join(f"{code(e, m)} AS {_code_name(e, m)}" for e, m in ALL_CODES) + " FROM c_px")
def _(spark, d):
    px = sv.pixels(data.samples(spark, d), W)
    return px.select("sample_id", "pos", *[encode(F.col("v"), e, m).alias(_code_name(e, m)) for e, m in ALL_CODES])


# --- words -----------------------------------------------------------------------


def _plain_words(spark, d):
    return explode_words(data.features(spark, d))


@query("pack_words", "SELECT sample_id, h, w FROM c_plain_words")
def _(spark, d):
    return _plain_words(spark, d).select("sample_id", "h", "w")


@query("pack_raw", f"SELECT sample_id, h, w FROM ({words_sql('id', 'mnist', 'raw')})")
def _(spark, d):
    s = data.samples(spark, d)
    return explode_words(s.select("sample_id", pack_array(F.col("px").cast("array<bigint>"), 8, 64).alias("words")))


@query("explode_bits", "SELECT sample_id, h, v FROM c_plain_bits")
def _(spark, d):
    return explode_bits(_plain_words(spark, d)).select("sample_id", "h", "v")


@query("xnor_match", """SELECT a.sample_id, a.h, CAST(4294967295 - xor(a.w, b.w) AS BIGINT) AS xnor_w, xor(a.w, b.w) AS xor_w
FROM c_plain_words a JOIN c_plain_words b ON b.sample_id = a.sample_id AND b.h = 15 - a.h""")
def _(spark, d):
    f = data.features(spark, d)
    pairs = f.select("sample_id", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.reverse("words").alias("b"))).alias("h", "_p"))
    a, b = F.col("_p.a"), F.col("_p.b")
    return pairs.select("sample_id", "h", xnor(a, b).alias("xnor_w"), a.bitwiseXOR(b).alias("xor_w"))


@query("popcount_sim", """SELECT a.sample_id, a.h, CAST(bit_count(a.w) AS INTEGER) AS ones, CAST(32 - bit_count(xor(a.w, b.w)) AS INTEGER) AS sim
FROM c_plain_words a JOIN c_plain_words b ON b.sample_id = a.sample_id AND b.h = 15 - a.h""")
def _(spark, d):
    f = data.features(spark, d)
    pairs = f.select("sample_id", F.posexplode_outer(F.arrays_zip(F.col("words").alias("a"), F.reverse("words").alias("b"))).alias("h", "_p"))
    a, b = F.col("_p.a"), F.col("_p.b")
    return pairs.select("sample_id", "h", F.bit_count(a).cast("int").alias("ones"), popcount_similarity(a, b).cast("int").alias("sim"))


def _group_sql(g: int) -> str:
    full = (1 << g) - 1
    bits = " + ".join(f"CASE WHEN ((w >> {k * g}) & {full}) = {full} THEN {1 << k} ELSE 0 END" for k in range(32 // g))
    return f"CAST({bits} AS BIGINT)" if g > 1 else "w"


@query("split_groups", "SELECT sample_id, h, " + ", ".join(f"{_group_sql(g)} AS g{g}" for g in (1, 2, 3, 4, 8, 16, 32)) + " FROM c_plain_words")
def _(spark, d):
    return _plain_words(spark, d).select(
        "sample_id", "h", *[split_groups(F.col("w"), g).alias(f"g{g}") for g in (1, 2, 3, 4, 8, 16, 32)])


@query("features_identity", "SELECT member_id, sample_id, h, w FROM c_trio_words")
def _(spark, d):
    return explode_words(data.features(spark, d, data.TRIO)).select("member_id", "sample_id", "h", "w")


@query("slice_words", "SELECT member_id, sample_id, h, w FROM c_corpus_words")
def _(spark, d):
    return explode_words(data.features(spark, d, data.CORPUS)).select("member_id", "sample_id", "h", "w")


@query("row_members", "SELECT CAST(h // 2 AS BIGINT) AS member_id, sample_id, CAST(h % 2 AS INTEGER) AS h, w FROM c_plain_words")
def _(spark, d):
    members = row_members(data.PLAIN[0], data.SHAPE)
    return explode_words(build_features(data.samples(spark, d), members, data.SHAPE)).select("member_id", "sample_id", "h", "w")


@query("features_out", """SELECT member_id, sample_id, split, label, array_to_string(list(w ORDER BY h), ',') AS words
FROM c_trio_words GROUP BY member_id, sample_id, split, label""")
def _(spark, d):
    f = data.features(spark, d, data.TRIO)
    text = F.concat_ws(",", F.transform("words", lambda w: w.cast("string")))
    return f.select("member_id", "sample_id", "split", "label", text.alias("words"))


# --- projection -------------------------------------------------------------------

H, NC, SEED = 8, 16, 42


def _seed_rows(spark, d):
    # one matrix row block per sample id: the generator keyed by the data's own rows
    return data.samples(spark, d).select(F.col("sample_id").alias("member_id"))


@query("w0_matrix", draws(f"(SELECT sample_id, CAST(h AS INTEGER) AS h, CAST(c AS INTEGER) AS c FROM c_samples, (SELECT unnest(range({H})) AS h), (SELECT unnest(range({NC})) AS c))",
                          f"({SEED} + sample_id)", f"(h * {NC} + c)", "sample_id, h, c").replace("SELECT sample_id, h, c,", "SELECT sample_id AS member_id, h, c,", 1))
def _(spark, d):
    seed, first = pj.member_seeds(SEED, "incr", 1, H * NC)
    return pj.random_matrix(_seed_rows(spark, d), H, NC, seed, first)


def _mode_sql(mode: str, seed: str, index: str) -> str:
    inner = draws(f"(SELECT sample_id, CAST(c AS INTEGER) AS c FROM c_samples, (SELECT unnest(range({NC})) AS c))", seed, index, "sample_id, c")
    return f"SELECT '{mode}' AS mode, sample_id AS member_id, c, w FROM ({inner})"


@query("w0_seed_modes", " UNION ALL ".join([
    _mode_sql("once", str(SEED), f"(sample_id * {NC} + c)"),
    _mode_sql("incr", f"({SEED} + sample_id)", "c"),
    _mode_sql("const", f"({SEED} + sample_id // 24)", "c")]))
def _(spark, d):
    parts = []
    for mode in ("once", "incr", "const"):
        seed, first = pj.member_seeds(SEED, mode, 24, NC)
        rows = pj.random_matrix(_seed_rows(spark, d), 1, NC, seed, first)
        parts.append(rows.select(F.lit(mode).alias("mode"), "member_id", "c", "w"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _w0(spark, groups: int = 1):
    seed, first = pj.member_seeds(SEED, "incr", 1, 0)
    members = spark.range(len(data.TRIO)).withColumnRenamed("id", "member_id")
    return pj.random_matrix(members, H, NC * groups, seed, first)


cte("c_w0", draws(f"(SELECT CAST(m AS BIGINT) AS member_id, CAST(h AS INTEGER) AS h, CAST(c AS INTEGER) AS c FROM (SELECT unnest(range(3)) AS m), (SELECT unnest(range({H})) AS h), (SELECT unnest(range({NC})) AS c))",
                  f"({SEED} + member_id)", f"(h * {NC} + c)", "member_id, h, c"))
cte("c_match", """SELECT x.member_id, x.sample_id, w0.h, x.h AS c, CAST(4294967295 - xor(x.w, w0.w) AS BIGINT) AS w
FROM c_trio_words x JOIN c_w0 w0 ON w0.member_id = x.member_id AND w0.c = x.h""")
cte("c_b32", "SELECT CAST(unnest(range(32)) AS INTEGER) AS b")


def _exact_sql(src: str, keys: str, half: int) -> str:
    return f"""SELECT {keys}, CAST(sum(CASE WHEN n > {half} THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM (
SELECT {keys}, b, sum((w >> b) & 1) AS n FROM {src}, c_b32 GROUP BY ALL) GROUP BY ALL"""


N_CELLS = 3 * H * NC


def _matches(spark, d):
    f = data.features(spark, d, data.TRIO).select("member_id", "sample_id", "words").repartition("sample_id")
    return pj.match_words(explode_words(f).withColumnRenamed("h", "c"), _w0(spark), N_CELLS)


cte("c_hidden", _exact_sql("c_match", "member_id, sample_id, h", NC // 2))


@query("project_words", "SELECT * FROM c_match")
def _(spark, d):
    return _matches(spark, d).select("member_id", "sample_id", "h", "c", "w")


@query("majority_exact", "SELECT * FROM c_hidden")
def _(spark, d):
    return pj.project(data.features(spark, d, data.TRIO), _w0(spark), N_CELLS, mj.threshold(NC))


@query("majority_exact_inline", "SELECT * FROM c_hidden")
def _(spark, d):
    seed, _first = pj.member_seeds(SEED, "incr", 1, 0)
    return pj.project_inline(data.features(spark, d, data.TRIO), H, NC, seed, mj.threshold(NC))


@query("majority_auto", _exact_sql("c_match", "member_id, sample_id, h", NC * 135 // 256))
def _(spark, d):
    return pj.project(data.features(spark, d, data.TRIO), _w0(spark), N_CELLS, mj.threshold(NC, "auto"))


@query("majority_rowwise", _exact_sql("(" + _exact_sql("(SELECT member_id, sample_id, h, c // 2 AS r, w FROM c_match)", "member_id, sample_id, h, r", 1) + ")",
                                      "member_id, sample_id, h", 1))
def _(spark, d):
    return mj.majority_rowwise(_arrays(spark, d), "match", NC, 2, 1).drop("match")


@query("majority_rowwise_single", "SELECT * FROM c_hidden")
def _(spark, d):
    """Rows that do not divide the words: one majority over all."""
    return mj.majority_rowwise(_arrays(spark, d), "match", NC, NC - 1, mj.threshold(NC)).drop("match")


@query("majority_wide", """SELECT member_id, CAST(sum(CASE WHEN n > half THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM (
SELECT member_id, b, sum((w >> b) & 1) AS n, count(*) // 2 AS half FROM c_match, c_b32 GROUP BY ALL) GROUP BY member_id""")
def _(spark, d):
    """One word per member over all its samples and units: tens of thousands of words in a group."""
    return mj.majority_exact(_matches(spark, d), ["member_id"], "w", F.floor(F.col("_n") / 2))


# groups of 16, 32 and 64 samples have the tuned sizes 256, 512 and 1024; what is left over has others
@query("majority_tuned", """SELECT member_id, h, per, g, CAST(sum(CASE WHEN n > half THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM (
SELECT member_id, h, per, sample_id // per AS g, b, sum((w >> b) & 1) AS n, CASE count(*) WHEN 196 THEN 107 WHEN 256 THEN 135 WHEN 512 THEN 269 WHEN 1024 THEN 540 ELSE count(*) * 135 // 256 END AS half
FROM c_match, c_b32, (SELECT CAST(unnest([16, 32, 64]) AS INTEGER) AS per) GROUP BY ALL) GROUP BY ALL""")
def _(spark, d):
    rows = _matches(spark, d).select("member_id", "sample_id", "h", "w", F.explode(F.array(F.lit(16), F.lit(32), F.lit(64))).alias("per"))
    placed = rows.withColumn("g", F.floor(F.col("sample_id") / F.col("per")))
    return mj.majority_exact(placed, ["member_id", "h", "per", "g"], "w", mj.threshold_of(F.col("_n")))


# pixel variants: four groups per hidden unit, each with its own block of random words
cte("c_w0px", draws(f"(SELECT CAST(m AS BIGINT) AS member_id, CAST(h AS INTEGER) AS h, CAST(c AS INTEGER) AS c FROM (SELECT unnest(range(3)) AS m), (SELECT unnest(range({H})) AS h), (SELECT unnest(range({4 * NC})) AS c))",
                    f"({SEED} + member_id)", f"(h * {4 * NC} + c)", "member_id, h, c"))
cte("c_pxmatch", f"""SELECT x.member_id, x.sample_id, w0.h, CAST(w0.c // {NC} AS INTEGER) AS g, x.h AS c, CAST(4294967295 - xor(x.w, w0.w) AS BIGINT) AS w
FROM c_trio_words x JOIN c_w0px w0 ON w0.member_id = x.member_id AND w0.c % {NC} = x.h""")


def _fields_sql(src: str, keys: str, half: int) -> str:
    return f"""SELECT {keys}, CAST(sum(CASE WHEN n > {half} THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM (
SELECT {keys}, b % 8 AS b, sum((w >> b) & 1) AS n FROM {src}, c_b32 GROUP BY ALL) GROUP BY ALL"""


def _shift_groups(src: str) -> str:
    return f"SELECT member_id, sample_id, h, CAST(sum(w << (8 * g)) AS BIGINT) AS w FROM ({src}) GROUP BY ALL"


def _px_arrays(spark, d):
    """Matches of a hidden unit with the random words of its four groups, group by group."""
    f = data.features(spark, d, data.TRIO).withColumn("words", F.flatten(F.array_repeat("words", 4)))
    return pj.match_arrays(f, _w0(spark, 4), 4 * N_CELLS)


@query("majority_pixel", _shift_groups(_fields_sql("c_pxmatch", "member_id, sample_id, h, g", NC * 4 // 2)))
def _(spark, d):
    return mj.majority_pixel(_px_arrays(spark, d), "match", NC, 8).drop("match")


@query("majority_pixel_rowwise", _shift_groups(_exact_sql(
    "(" + _fields_sql("(SELECT member_id, sample_id, h, g, c // 2 AS r, w FROM c_pxmatch)", "member_id, sample_id, h, g, r", 4) + ")",
    "member_id, sample_id, h, g", NC // 2 // 2)))
def _(spark, d):
    return mj.majority_pixel_rowwise(_px_arrays(spark, d), "match", NC, 2, 8).drop("match")


def _need_sql(groups: list[tuple[str, int]], src: str, base: int, n: int) -> tuple[str, int]:
    """One tree level: bit on if the group's required count is reached."""
    sizes = mj.tree_level(n, base)
    used = sum(sizes)
    first, rows = 0, []
    for g, size in enumerate(sizes):
        need = dict(groups)[size]
        rows.append(f"({g}, {first}, {first + size - 1}, {need})")
        first += size
    plan = f"(VALUES {', '.join(rows)}) AS t(g, lo, hi, need)"
    sql = f"""SELECT member_id, sample_id, h, g AS c, CAST(sum(CASE WHEN n >= need THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS w FROM (
SELECT member_id, sample_id, h, t.g, t.need, b, sum((w >> b) & 1) AS n FROM {src} m JOIN {plan} ON m.c BETWEEN t.lo AND t.hi, c_b32
WHERE m.c < {used} GROUP BY ALL) GROUP BY ALL"""
    return sql, len(sizes)


def _tree_sql(src: str, n: int, base: int) -> str:
    rules = list({3: {1: 1, 2: 2, 3: 2, 4: 3, 5: 3}, 4: {1: 1, 2: 1, 3: 1, 4: 2}, 5: {1: 1, 2: 2, 3: 3, 4: 4, 5: 4},
                  7: {1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5, 7: 5}}[base].items())
    while n > 1:
        sql, n = _need_sql(rules, src, base, n)
        src = f"({sql})"
    return f"SELECT member_id, sample_id, h, w FROM {src}"


def _arrays(spark, d):
    return pj.match_arrays(data.features(spark, d, data.TRIO), _w0(spark), N_CELLS)


def _tree_query(base: int) -> None:
    @query(f"majority_tree{base}", _tree_sql("c_match", NC, base))
    def _(spark, d):
        return mj.majority_tree(_arrays(spark, d), "match", NC, base).drop("match")


for _base in (3, 4, 5, 7):
    _tree_query(_base)


@query("majority_tree3_step", _tree_sql("(SELECT member_id, sample_id, h, c // 2 AS c, w FROM c_match WHERE c % 2 = 0)", 8, 3))
def _(spark, d):
    return mj.majority_tree3_step(_arrays(spark, d), "match", NC, 2).drop("match")


# fields of a word in order, and triples that are 6 fields apart, packed four to a word
cte("c_fields", "SELECT member_id, sample_id, h, c * 4 + k AS f, (w >> CAST(8 * k AS INTEGER)) & 255 AS x FROM c_match, (SELECT unnest(range(4)) AS k)")
_starts = [i for i in range(0, 64, 18) if i + 12 < 64]


@query("majority_tree3_pixel_far", _tree_sql(f"""(SELECT member_id, sample_id, h, t // 4 AS c, CAST(sum(m << CAST(8 * (t % 4) AS INTEGER)) AS BIGINT) AS w FROM (
SELECT a.member_id, a.sample_id, a.h, a.f // 18 AS t, (a.x & b.x) | (a.x & c.x) | (b.x & c.x) AS m FROM c_fields a
JOIN c_fields b ON b.member_id = a.member_id AND b.sample_id = a.sample_id AND b.h = a.h AND b.f = a.f + 6
JOIN c_fields c ON c.member_id = a.member_id AND c.sample_id = a.sample_id AND c.h = a.h AND c.f = a.f + 12
WHERE a.f % 18 = 0) GROUP BY ALL)""", -(-len(_starts) // 4), 3))
def _(spark, d):
    return mj.majority_tree3_pixel_step(_arrays(spark, d), "match", NC, 6).drop("match")


# neighbouring fields: NC = 16 words give 4 whole groups and one of 4 words; then 5 values are left per slot
def _near_sql(step: int) -> str:
    first = []
    for g, (word, size, need) in enumerate([(0, 3, 2), (3, 3, 2), (6, 3, 2), (9, 3, 2), (12, 4, 3)]):
        for k in range(size):
            first += [f"({g}, {slot}, {word * 4 + slot + k * step}, {need})" for slot in range(4)]
    plan = f"(VALUES {', '.join(first)}) AS t(g, slot, f, need)"
    one = f"""SELECT member_id, sample_id, h, slot, g, b, CASE WHEN sum((x >> b) & 1) >= need THEN 1 ELSE 0 END AS bit
FROM c_fields m JOIN {plan} ON t.f = m.f, (SELECT CAST(unnest(range(8)) AS INTEGER) AS b) GROUP BY member_id, sample_id, h, slot, g, need, b"""
    two = f"""SELECT member_id, sample_id, h, slot, g2, b, CASE WHEN sum(bit) >= 2 THEN 1 ELSE 0 END AS bit FROM (
SELECT *, CASE WHEN g < 3 THEN 0 ELSE 1 END AS g2 FROM ({one})) GROUP BY ALL"""
    three = f"SELECT member_id, sample_id, h, slot, b, CASE WHEN sum(bit) >= 2 THEN 1 ELSE 0 END AS bit FROM ({two}) GROUP BY ALL"
    return f"SELECT member_id, sample_id, h, CAST(sum(CAST(bit AS BIGINT) << CAST(slot * 8 + b AS INTEGER)) AS BIGINT) AS w FROM ({three}) GROUP BY ALL"


@query("majority_tree3_pixel_near", _near_sql(2))
def _(spark, d):
    return mj.majority_tree3_pixel_step(_arrays(spark, d), "match", NC, 2).drop("match")


@query("majority_or", "SELECT member_id, sample_id, h, bit_or(w) AS w FROM c_match GROUP BY ALL")
def _(spark, d):
    return mj.majority_or(_matches(spark, d), ["member_id", "sample_id", "h"], "w")


@query("leaky_features", f"""SELECT member_id, sample_id, h, round(CASE WHEN z < 0 THEN z * 0.05e0 ELSE z END, 6) AS z FROM (
SELECT w.member_id, p.sample_id, w.h, sum((p.v / 255e0 * 2e0 - 1e0) * ((w.w / 4294967296e0 * 2e0 - 1e0) * 0.125e0)) AS z FROM c_px p JOIN (
{draws(f"(SELECT CAST(0 AS BIGINT) AS member_id, CAST(h AS INTEGER) AS h, CAST(c AS INTEGER) AS c FROM (SELECT unnest(range({H})) AS h), (SELECT unnest(range(64)) AS c))", str(SEED), "(h * 64 + c)", "member_id, h, c")}) w ON w.c = p.pos GROUP BY ALL)""")
def _(spark, d):
    return readout_inputs(spark, d).withColumn("z", F.round("z", 6))


def readout_inputs(spark, d):
    """Leaky random features of the samples, values scaled to [-1, 1]."""
    x = data.samples(spark, d).select(
        F.lit(0).cast("bigint").alias("member_id"), "sample_id", F.transform("px", lambda v: v / 255.0 * 2.0 - 1.0).alias("x"))
    members = spark.range(1).withColumnRenamed("id", "member_id")
    return pj.leaky_features(x, members, 1, H, 64, F.lit(SEED).cast("bigint"))


@query("float_pack", "SELECT sample_id, CAST(pos // 4 AS INTEGER) AS pos, round(sum(v) / 4e0 / 127.5e0 - 1e0, 9) AS x FROM c_px GROUP BY ALL")
def _(spark, d):
    s = data.samples(spark, d)
    packed = s.select("sample_id", F.posexplode_outer(pj.float_pack(F.col("px"), 64)).alias("pos", "x"))
    return packed.withColumn("x", F.round("x", 9))


# --- grids --------------------------------------------------------------------------


def _grid_query(xform: str) -> None:
    @query(f"grid_{xform.replace('-', '_')}", f"SELECT sample_id, CAST(pos AS INTEGER) AS pos, CAST(v AS INTEGER) AS v FROM ({grid_sql(xform)})")
    def _(spark, d):
        s = data.samples(spark, d)
        return s.select("sample_id", F.posexplode_outer(apply_xform(F.col("px"), xform, data.SHAPE)).alias("pos", "v"))


for _name in XFORMS:
    _grid_query(_name)

CHAIN = "rot22@sft-u1@avg4@hflip"


def _chain() -> str:
    src = "c_px"
    for step in CHAIN.split("@"):
        src = f"({grid_sql(step, src)})"
    return src


@query("grid_chain", f"SELECT sample_id, CAST(pos AS INTEGER) AS pos, v FROM {_chain()}")
def _(spark, d):
    s = data.samples(spark, d)
    return s.select("sample_id", F.posexplode_outer(apply_xform(F.col("px"), CHAIN, data.SHAPE)).alias("pos", "v"))


@query("grid_planes", """SELECT k.sample_id, CAST(p.p * 25 + d.d AS INTEGER) AS pos, x.v FROM c_samples k, (SELECT unnest(range(3)) AS p) p, (SELECT unnest(range(25)) AS d) d
JOIN c_padded x ON x.pos = p.p * 25 + (d.d // 5) * 5 + 4 - d.d % 5 WHERE x.sample_id = k.sample_id""")
def _(spark, d):
    s = data.rgb_samples(spark, d)
    return s.select("sample_id", F.posexplode_outer(apply_xform(F.col("px"), "hflip", data.RGB_SHAPE)).alias("pos", "v"))


# --- channels -----------------------------------------------------------------------

_color_sql = {
    "R": "r", "G": "g", "B": "b", "Y": "(r * 77 + g * 150 + b * 29) >> 8", "YL": "(r * 54 + g * 183 + b * 18) >> 8",
    "AL": "(r + g) >> 1", "BL": "(r + b) >> 1", "CL": "(g + b) >> 1",
    "AM": "128 + r - g", "BM": "128 + r - b", "CM": "128 + g - b", "RG": "128 + r - g", "RB": "128 + r - b", "GB": "128 + g - b",
    "AP": "128 + b - (r + g) // 2", "BP": "128 + g - (r + b) // 2", "CP": "128 + r - (g + b) // 2",
    "S": "greatest(r, g, b) - least(r, g, b)",
}


@query("color_points", " UNION ALL ".join(
    f"SELECT sample_id, CAST(pos AS INTEGER) AS pos, '{c}' AS channel, CAST(least(255, greatest(0, {_color_sql[c]})) AS INTEGER) AS v FROM c_rgb" for c in POINT_CHANNELS))
def _(spark, d):
    cells = _rgb_cells(spark, d)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), color_channel(c, r, g, b).alias("v")) for c in POINT_CHANNELS])
    return cells.select("sample_id", "pos", F.inline(rows))


def _rgb_cells(spark, d):
    s = data.rgb_samples(spark, d)
    at = [F.slice("px", 1 + data.RGB_SHAPE.size * p, data.RGB_SHAPE.size) for p in range(3)]
    zipped = F.arrays_zip(at[0].alias("r"), at[1].alias("g"), at[2].alias("b"))
    return s.select("sample_id", F.posexplode_outer(zipped).alias("pos", "_c")).select("sample_id", "pos", "_c.r", "_c.g", "_c.b")


@query("color_hue", "SELECT sample_id, CAST(pos AS INTEGER) AS pos, CAST(least(255, greatest(0, trunc((atan2(CAST(g - b AS DOUBLE), CAST(2 * r - g - b AS DOUBLE)) / (2e0 * pi()) + 0.5e0) * 255e0))) AS INTEGER) AS v FROM c_rgb")
def _(spark, d):
    return _rgb_cells(spark, d).select("sample_id", "pos", hue(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def _stencil_query(kind: str) -> None:
    @query(f"stencil_{kind}", stencil_sql(kind))
    def _(spark, d):
        s = with_channel(data.samples(spark, d), kind, data.SHAPE)
        return s.select("sample_id", F.posexplode_outer("px").alias("pos", "v"))


for _name in ("edge", "bin", "lbp", "dog", "var", "dir", "range"):
    _stencil_query(_name)


def _rgb_stencil_query(name: str, kind: str, source: str) -> None:
    src = f"(SELECT sample_id, pos, CAST(least(255, greatest(0, {_color_sql[source]})) AS INTEGER) AS v FROM c_rgb)"

    @query(f"stencil_{name.replace('-', '_')}", stencil_sql(kind, src, data.RGB_SHAPE.width))
    def _(spark, d):
        s = with_channel(data.rgb_samples(spark, d), "C" if name == "contrast" else name, data.RGB_SHAPE)
        return s.select("sample_id", F.posexplode_outer("px").alias("pos", "v"))


for _name, _kind, _source in [("contrast", "C", "AL"), ("lbp-rg", "lbp", "RG"), ("lbp-rb", "lbp", "RB"), ("lbp-gb", "lbp", "GB")]:
    _rgb_stencil_query(_name, _kind, _source)
