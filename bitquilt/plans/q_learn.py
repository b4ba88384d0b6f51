"""Queries: counting, log-odds, scoring, prototypes, training, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as ln
from ..operators import project as pj
from ..operators import reports as rp
from ..operators import score as sc
from ..operators import train as tr
from ..operators.majority import threshold
from ..operators.members import plan_sweep, resume_sweep
from ..session import cut, new_table_path
from ..sources import corpus as cp
from . import data
from .features import Member, batches, build_features
from .q_features import H, N_CELLS, NC, SEED, readout_inputs
from .registry import cte, query
from .sql import draws, register_learning

CLS = range(10)


def _train(spark, d):
    return data.stored_features(spark, d, data.TRIO).where("split = 'train'")


@query("class_counts", "SELECT member_id, class_id, n_k FROM c_trio_nk")
def _(spark, d):
    return ln.class_counts(_train(spark, d))


@query("hit_counts", "SELECT member_id, class_id, h, v, t FROM c_trio_hits")
def _(spark, d):
    return ln.hit_counts(_train(spark, d)).select("member_id", "class_id", "h", "v", "t")


_target = {
    "count": "t", "inverse": "t", "uniform": "1", "prior": "n_k", "laplace": "CASE WHEN t < n_k THEN t + 1 ELSE t END", "dampen": "t >> 1",
}
_joined = "c_trio_hits t JOIN c_trio_nk n ON n.member_id = t.member_id AND n.class_id = t.class_id"
_random = draws(f"(SELECT t.member_id, t.class_id, t.h, t.v, n_k FROM {_joined})", "(42 + member_id)", "((class_id * 16 + h) * 32 + v)", "member_id, class_id, h, v, n_k")


def _init_query(mode: str) -> None:
    if mode == "random":
        sql = f"SELECT member_id, class_id, h, v, CAST(CASE WHEN n_k > 0 THEN w % (n_k + 1) ELSE 0 END AS BIGINT) AS t FROM ({_random})"
    else:
        sql = f"SELECT t.member_id, t.class_id, t.h, t.v, CAST({_target[mode]} AS BIGINT) AS t FROM {_joined}"

    @query(f"target_init_{mode}", sql)
    def _(spark, d):
        train = _train(spark, d)
        return ln.initial_target(ln.hit_counts(train), ln.class_counts(train), mode).drop("n_k")


for _mode in ln.MODES:
    _init_query(_mode)


@query("log_odds", "SELECT member_id, class_id, h, v, w FROM c_trio_w")
def _(spark, d):
    return ln.fit(data.features(spark, d, data.TRIO))[0]


@query("log_odds_inverse", "SELECT member_id, class_id, h, v, -w AS w FROM c_trio_w")
def _(spark, d):
    return ln.fit(data.features(spark, d, data.TRIO), "inverse")[0]


@query("class_offset", "SELECT member_id, class_id, off FROM c_trio_off")
def _(spark, d):
    return ln.fit(data.features(spark, d, data.TRIO))[1]


def _scored(spark, d, members=data.TRIO):
    f = data.stored_features(spark, d, members)
    return sc.score_wide(f, *ln.fit(f))


@query("score_samples", "SELECT member_id, sample_id, class_id, score FROM c_trio_scores")
def _(spark, d):
    return sc.long(_scored(spark, d), ["member_id", "sample_id"])


@query("scores_all_splits", "SELECT member_id, sample_id, split, class_id, score FROM c_trio_scores")
def _(spark, d):
    return sc.long(_scored(spark, d), ["member_id", "sample_id", "split"])


@query("argmax", "SELECT member_id, sample_id, pred FROM c_trio_pred")
def _(spark, d):
    return sc.predictions(_scored(spark, d)).select("member_id", "sample_id", "pred")


@query("margins", "SELECT member_id, sample_id, margin FROM c_trio_pred")
def _(spark, d):
    return rp.sample_margins(_scored(spark, d))


@query("argmax_nonzero", """SELECT sample_id, CAST(arg_max(class_id, total * 16 - class_id) FILTER (total <> 0) AS INTEGER) AS pred FROM (
SELECT sample_id, class_id, CAST(sum(score) AS BIGINT) // 1000000 AS total FROM c_trio_scores GROUP BY ALL) GROUP BY sample_id""")
def _(spark, d):
    # whole millions, so that totals of exactly 0 occur
    sums = sc.ensemble_sum(_scored(spark, d), ["sample_id"])
    coarse = [F.expr(f"CAST(floor(s{k} / 1000000) AS BIGINT)") for k in CLS]
    return sums.select("sample_id", sc.best_class_nonzero(coarse).alias("pred"))


@query("ensemble_sum", "SELECT sample_id, class_id, CAST(sum(score) AS BIGINT) AS score FROM c_trio_scores GROUP BY ALL")
def _(spark, d):
    return sc.long(sc.ensemble_sum(_scored(spark, d), ["sample_id"]), ["sample_id"])


@query("votes_normalised", """SELECT sample_id, class_id, CAST(sum(CASE WHEN m > 0 THEN sign(score) * (abs(score) * 16777216 // m) ELSE score END) AS BIGINT) AS score
FROM (SELECT *, max(abs(score)) OVER (PARTITION BY member_id, sample_id) AS m FROM c_trio_scores) GROUP BY ALL""")
def _(spark, d):
    votes = sc.votes_normalised(_scored(spark, d))
    return sc.long(sc.ensemble_sum(votes, ["sample_id"]), ["sample_id"])


@query("member_accuracy", """SELECT member_id, split, CAST(count(*) FILTER (pred = label) AS BIGINT) AS correct,
CAST(count(*) FILTER (pred <> label) AS BIGINT) AS errors, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc
FROM c_trio_pred GROUP BY ALL""")
def _(spark, d):
    return sc.accuracy(sc.predictions(_scored(spark, d)), ["member_id", "split"])


@query("predictions", """SELECT sample_id, CAST(arg_max(class_id, total * 16 - class_id) AS INTEGER) AS pred FROM (
SELECT sample_id, class_id, CAST(sum(score) AS BIGINT) AS total FROM c_trio_scores WHERE split = 'eval' GROUP BY ALL) GROUP BY sample_id""")
def _(spark, d):
    sums = sc.ensemble_sum(_scored(spark, d).where("split = 'eval'"), ["sample_id"])
    return sc.predictions(sums).select("sample_id", "pred")


@query("weight_extremes", """SELECT member_id, min(w) AS min_w,
 CAST(arg_min(class_id, w::HUGEINT * 100000 + class_id * 1000 + h * 32 + v) AS INTEGER) AS min_class,
 CAST(arg_min(h, w::HUGEINT * 100000 + class_id * 1000 + h * 32 + v) AS INTEGER) AS min_h,
 CAST(arg_min(v, w::HUGEINT * 100000 + class_id * 1000 + h * 32 + v) AS INTEGER) AS min_v, max(w) AS max_w,
 CAST(arg_max(class_id, w::HUGEINT * 100000 - class_id * 1000 - h * 32 - v) AS INTEGER) AS max_class,
 CAST(arg_max(h, w::HUGEINT * 100000 - class_id * 1000 - h * 32 - v) AS INTEGER) AS max_h,
 CAST(arg_max(v, w::HUGEINT * 100000 - class_id * 1000 - h * 32 - v) AS INTEGER) AS max_v
FROM c_trio_w GROUP BY member_id""")
def _(spark, d):
    return rp.weight_extremes(ln.fit(data.features(spark, d, data.TRIO))[0])


@query("report", """SELECT train_pct, eval_pct, errors, CAST(3 AS BIGINT) AS members, eval_pct - 0.02e0 * 2 AS eff FROM (
SELECT count(*) FILTER (split = 'train' AND pred = label) * 100e0 / count(*) FILTER (split = 'train') AS train_pct,
 count(*) FILTER (split = 'eval' AND pred = label) * 100e0 / count(*) FILTER (split = 'eval') AS eval_pct,
 count(*) FILTER (split = 'eval' AND pred <> label) AS errors FROM (
SELECT sample_id, split, label, arg_max(class_id, total * 16 - class_id) AS pred FROM (
SELECT sample_id, split, label, class_id, CAST(sum(score) AS BIGINT) AS total FROM c_trio_scores GROUP BY ALL) GROUP BY sample_id, split, label))""")
def _(spark, d):
    preds = sc.predictions(sc.ensemble_sum(_scored(spark, d), ["sample_id", "split", "label"]))
    return rp.report(preds.where("split = 'train'"), preds.where("split = 'eval'"), len(data.TRIO))


# --- prototypes -------------------------------------------------------------------


def _proto_cte(name: str, percent: int) -> None:
    cte(name, f"""SELECT g.member_id, k.class_id, g.h, CAST(coalesce(sum(CASE WHEN t.t > greatest(1, (n.n_k * {percent} + 50) // 100) THEN 1::BIGINT << t.v ELSE 0 END), 0) AS BIGINT) AS w
FROM (SELECT DISTINCT member_id, h FROM c_trio_hits WHERE t > 0) g CROSS JOIN c_classes k
JOIN c_trio_hits t ON t.member_id = g.member_id AND t.class_id = k.class_id AND t.h = g.h
JOIN c_trio_nk n ON n.member_id = g.member_id AND n.class_id = k.class_id GROUP BY ALL""")


_proto_cte("c_proto50", 50)
_proto_cte("c_proto30", 30)


@query("prototypes", "SELECT member_id, class_id, h, w FROM c_proto50")
def _(spark, d):
    return rp.prototypes(data.features(spark, d, data.TRIO), 50)


@query("prototype_score", """SELECT x.member_id, x.sample_id, k.class_id, CAST(sum(32 - bit_count(xor(x.w, coalesce(p.w, 0)))) AS BIGINT) AS score
FROM c_trio_words x CROSS JOIN c_classes k LEFT JOIN c_proto50 p ON p.member_id = x.member_id AND p.h = x.h AND p.class_id = k.class_id GROUP BY ALL""")
def _(spark, d):
    f = data.stored_features(spark, d, data.TRIO)
    return sc.long(rp.prototype_scores(f, rp.prototypes(f, 50)), ["member_id", "sample_id"])


@query("prototype_flips", """SELECT a.member_id, CAST(sum(bit_count(xor(a.w, b.w))) AS BIGINT) AS flips FROM c_proto50 a
JOIN c_proto30 b ON b.member_id = a.member_id AND b.class_id = a.class_id AND b.h = a.h GROUP BY ALL""")
def _(spark, d):
    f = data.stored_features(spark, d, data.TRIO)
    return rp.prototype_flips(rp.prototypes(f, 50), rp.prototypes(f, 30))


_proto_cte("c_proto40", 40)


def _proto_eval(percent: int) -> str:
    return f"""SELECT {percent} AS percent, count(*) FILTER (pred = label) AS ok FROM (
SELECT member_id, sample_id, label, arg_max(class_id, score * 16 - class_id) AS pred FROM (
SELECT x.member_id, x.sample_id, x.label, k.class_id, sum(32 - bit_count(xor(x.w, coalesce(p.w, 0)))) AS score
FROM c_trio_words x CROSS JOIN c_classes k LEFT JOIN c_proto{percent} p ON p.member_id = x.member_id AND p.h = x.h AND p.class_id = k.class_id
WHERE x.split = 'eval' GROUP BY ALL) GROUP BY member_id, sample_id, label)"""


@query("train_prototypes", " UNION ALL ".join(f"SELECT member_id, class_id, h, w FROM c_proto{p} WHERE (SELECT percent FROM c_proto_best) = {p}" for p in (50, 40, 30)))
def _(spark, d):
    protos, _history = tr.train_prototypes(data.stored_features(spark, d, data.TRIO), 3)
    return protos


cte("c_proto_best", "SELECT percent FROM (" + " UNION ALL ".join(_proto_eval(p) for p in (50, 40, 30)) + ") ORDER BY ok DESC, percent DESC LIMIT 1")

# --- correction ---------------------------------------------------------------------

STEP = 16384

_errors = """SELECT p.member_id, p.sample_id, p.label, p.pred, a.score - b.score AS gap FROM c_trio_pred p
JOIN c_trio_scores a ON a.member_id = p.member_id AND a.sample_id = p.sample_id AND a.class_id = p.pred
JOIN c_trio_scores b ON b.member_id = p.member_id AND b.sample_id = p.sample_id AND b.class_id = p.label
WHERE p.split = 'train' AND p.pred <> p.label"""


def _pass_sql(errors: str) -> str:
    return f"""SELECT w.member_id, w.class_id, w.h, w.v, CAST(w.w + coalesce(d.delta, 0) AS BIGINT) AS w FROM c_trio_w w LEFT JOIN (
SELECT b.member_id, e.class_id, b.h, b.v, sum(e.d) AS delta FROM c_trio_bits b JOIN (
 SELECT member_id, sample_id, label AS class_id, step AS d FROM ({errors}) UNION ALL
 SELECT member_id, sample_id, pred, -step FROM ({errors})) e ON e.member_id = b.member_id AND e.sample_id = b.sample_id GROUP BY ALL) d
ON d.member_id = w.member_id AND d.class_id = w.class_id AND d.h = w.h AND d.v = w.v"""


@query("correct_pass", _pass_sql(f"SELECT *, CASE WHEN gap < 131072 THEN greatest(1, ({STEP} * gap) >> 17) ELSE {STEP} END AS step FROM ({_errors}) WHERE gap > 0"))
def _(spark, d):
    f = data.stored_features(spark, d, data.TRIO)
    return tr.correct_pass(f.where("split = 'train'"), *ln.fit(f), STEP)


@query("correct_pass_nogap", _pass_sql(f"SELECT *, {STEP} AS step FROM ({_errors})"))
def _(spark, d):
    f = data.stored_features(spark, d, data.TRIO)
    return tr.correct_pass(f.where("split = 'train'"), *ln.fit(f), STEP, use_gap=False)


@query("train_correct")
def _(spark, d):
    f = data.stored_features(spark, d, data.PLAIN)
    return tr.history_table(tr.train_correct(f, 3, STEP, warmup=1, gap_k=1.0), f)


@query("train_rollback")
def _(spark, d):
    f = data.stored_features(spark, d, data.PLAIN)
    return tr.history_table(tr.train_correct(f, 3, 4 * STEP, rollback=True), f)


@query("sweep_train")
def _(spark, d):
    """Plan a sweep, skip what exists, train the rest and write its scores."""
    planned = plan_sweep(spark, ["id", "rot90"], ["mnist"], ["lin", "exp"], [8])
    done = planned.where("spec = 'id:mnist:lin8'")
    # catalogue-sized: one row per planned member
    todo = [Member(i, r["xform"], r["channel"], r["encoding"], r["width"])
            for i, r in enumerate(resume_sweep(planned, done).orderBy("spec").collect())]
    paths = []
    for batch in batches(todo):
        f = cut(build_features(data.spread_samples(spark, d), batch, data.SHAPE), "features")
        result = tr.train_correct(f, 1, STEP)
        paths.append(new_table_path(spark, "sweep"))
        cp.write_scores(sc.score_wide(f, result.weights, result.offsets), paths[-1])
    stored = spark.read.parquet(*paths)
    return sc.accuracy(sc.predictions(stored), ["member_id", "split"])


# --- models and inference -------------------------------------------------------------


def _members(spark):
    rows = [(m.member_id, m.spec) for m in data.TRIO]
    return spark.createDataFrame(rows, "member_id LONG, spec STRING")


def _stored_model(spark, d):
    path = new_table_path(spark, "model")
    weights, offsets = ln.fit(data.features(spark, d, data.TRIO))
    cp.write_model(path, _members(spark), weights, offsets)
    return cp.read_model(spark, path)


@query("model_roundtrip", "SELECT member_id, class_id, h, v, w FROM c_trio_w")
def _(spark, d):
    return _stored_model(spark, d)["weights"]


@query("infer", """SELECT sample_id, label, CAST(arg_max(class_id, total * 16 - class_id) AS INTEGER) AS pred FROM (
SELECT sample_id, label, class_id, CAST(sum(score) AS BIGINT) AS total FROM c_trio_scores WHERE split = 'eval' GROUP BY ALL) GROUP BY sample_id, label""")
def _(spark, d):
    model = _stored_model(spark, d)
    f = data.features(spark, d, data.TRIO).where("split = 'eval'")
    scores = sc.score_wide(f, model["weights"], model["offsets"])
    return sc.predictions(sc.ensemble_sum(scores, ["sample_id", "label"])).select("sample_id", "label", "pred")


# --- projected and grouped features, end to end -------------------------------------------


_pairs = " + ".join(f"CASE WHEN ((w >> {2 * k}) & 3) = 3 THEN {1 << k} ELSE 0 END" for k in range(16))
register_learning("proj", f"""SELECT x.member_id, x.sample_id, s.split, s.label, x.h, CAST({_pairs} AS BIGINT) AS w
FROM c_hidden x JOIN c_samples s USING (sample_id)""", 16)


@query("infer_projected", """SELECT member_id, split, CAST(count(*) FILTER (pred = label) AS BIGINT) AS correct,
CAST(count(*) FILTER (pred <> label) AS BIGINT) AS errors, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM c_proj_pred GROUP BY ALL""")
def _(spark, d):
    """Projection, majority, split groups of 2, counting, scoring."""
    f = data.stored_features(spark, d, data.TRIO)
    seed, _first = pj.member_seeds(SEED, "incr", 1, 0)
    w0 = pj.random_matrix(spark.range(len(data.TRIO)).withColumnRenamed("id", "member_id"), H, NC, seed)
    hidden = pj.gather_words(pj.project(f, w0, N_CELLS, threshold(NC)), ["member_id", "sample_id"])
    grouped = hidden.withColumn("words", pj.group_bits(F.col("words"), 2))
    g = cut(f.drop("words").join(grouped, ["member_id", "sample_id"]), "features")
    return sc.accuracy(sc.predictions(sc.score_wide(g, *ln.fit(g, n_bits=16))), ["member_id", "split"])


# --- linear read-out -----------------------------------------------------------------------


def _readout(spark, d):
    z = readout_inputs(spark, d).groupBy("member_id", "sample_id").agg(
        F.array_sort(F.collect_list(F.struct("h", "z"))).alias("_z"))
    s = data.samples(spark, d).select("sample_id", "split", "label")
    return z.select("member_id", "sample_id", F.col("_z.z").alias("z")).join(s, "sample_id")


@query("train_readout")
def _(spark, d):
    f = _readout(spark, d)
    model = tr.train_readout(f, 8)
    return sc.accuracy(sc.predictions(tr.readout_scores(f, model)), ["member_id", "split"])


@query("readout_vote")
def _(spark, d):
    """Sum of the outputs of two read-outs trained with different strength."""
    f = _readout(spark, d)
    both = [tr.readout_scores(f.withColumn("member_id", F.lit(i).cast("bigint")), tr.train_readout(f, 8, regularisation=r))
            for i, r in enumerate((0.05, 0.5))]
    total = sc.ensemble_sum(both[0].unionByName(both[1]), ["sample_id", "split", "label"])
    return sc.accuracy(sc.predictions(total), ["split"])


