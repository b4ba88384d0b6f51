"""Queries: reports and searches over the score table of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as rp
from ..operators import score as sc
from ..operators import search as se
from ..session import cut
from . import data
from .registry import cte, query


def _fact(spark, d):
    return data.corpus_scores(spark, d)


def _preds(spark, d):
    return sc.predictions(_fact(spark, d))


# --- documented queries over the sample index ---------------------------------------


@query("pairs", "SELECT member_id, sample_id, pred, margin FROM c_pred")
def _(spark, d):
    return rp.pairs(_fact(spark, d))


def _index(spark, d):
    fact = _fact(spark, d)
    members = data.corpus_members(spark).select("member_id", F.col("spec").alias("name"))
    samples = data.samples(spark, d).select("sample_id", "label")
    return rp.pairs(fact), members, samples


@query("q_who_recognises", """SELECT p.sample_id, m.spec AS name, p.pred, p.margin FROM c_pred p JOIN c_members m USING (member_id)
WHERE p.sample_id = (SELECT max(sample_id) FROM c_pred WHERE label = 6)""")
def _(spark, d):
    pairs, members, samples = _index(spark, d)
    one = samples.where("label = 6").join(pairs.select("sample_id").distinct(), "sample_id", "left_semi").agg(F.max("sample_id")).scalar()
    return pairs.where(F.col("sample_id") == one).join(members, "member_id").select("sample_id", "name", "pred", "margin")


@query("q_member_sees_class", "SELECT sample_id, margin FROM c_pred WHERE member_id = 5 AND pred = 6")
def _(spark, d):
    return rp.pairs(_fact(spark, d)).where("member_id = 5 AND pred = 6").select("sample_id", "margin")


def _seen_as(spark, d, label: int, pred: int):
    pairs, members, samples = _index(spark, d)
    hits = pairs.where(F.col("pred") == pred).join(samples.where(F.col("label") == label), "sample_id", "left_semi")
    return hits.groupBy("member_id").agg(F.count("*").alias("n")).join(members, "member_id").select("member_id", "name", "n")


def _seen_sql(label: int, pred: int) -> str:
    return f"""SELECT p.member_id, m.spec AS name, count(*) AS n FROM c_pred p JOIN c_members m ON m.member_id = p.member_id
JOIN c_samples s ON s.sample_id = p.sample_id WHERE s.label = {label} AND p.pred = {pred} GROUP BY ALL"""


@query("q_specialists", _seen_sql(6, 6))
def _(spark, d):
    return _seen_as(spark, d, 6, 6)


@query("q_confusers", _seen_sql(6, 0))
def _(spark, d):
    return _seen_as(spark, d, 6, 0)


# --- accuracies --------------------------------------------------------------------------

cte("c_acc", """SELECT member_id, count(*) FILTER (pred = label) AS correct, count(*) AS n, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM c_pred GROUP BY member_id""")


@query("acc_target", """SELECT member_id, CAST(count(*) FILTER (pred = label AND label IN (1, 6)) AS BIGINT) AS correct,
CAST(count(*) FILTER (label IN (1, 6) AND pred <> label) AS BIGINT) AS errors,
count(*) FILTER (pred = label AND label IN (1, 6)) * 100e0 / count(*) FILTER (label IN (1, 6)) AS acc FROM c_pred GROUP BY member_id""")
def _(spark, d):
    return sc.accuracy(_preds(spark, d), ["member_id"], [1, 6])


@query("acc_binary", """SELECT member_id, CAST(count(*) FILTER ((label IN (1, 6)) = (pred IN (1, 6))) AS BIGINT) AS correct,
CAST(count(*) FILTER ((label IN (1, 6)) <> (pred IN (1, 6))) AS BIGINT) AS errors,
count(*) FILTER ((label IN (1, 6)) = (pred IN (1, 6))) * 100e0 / count(*) AS acc FROM c_pred GROUP BY member_id""")
def _(spark, d):
    return sc.accuracy(_preds(spark, d), ["member_id"], [1, 6], binary=True)


@query("eval_filter_sample", """SELECT member_id, count(*) FILTER (pred = label) AS correct, count(*) FILTER (pred <> label) AS errors,
count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM c_pred WHERE label IN (0, 2, 4) GROUP BY member_id""")
def _(spark, d):
    return sc.accuracy(_preds(spark, d).where("label IN (0, 2, 4)"), ["member_id"])


cte("c_clarity", """SELECT member_id, avg(sd) AS clarity FROM (SELECT member_id, sample_id, stddev_pop(score) AS sd FROM c_fact GROUP BY ALL) GROUP BY member_id""")


@query("clarity", "SELECT member_id, round(clarity, 3) AS clarity FROM c_clarity")
def _(spark, d):
    return sc.clarity(_fact(spark, d)).withColumn("clarity", F.round("clarity", 3))


@query("member_stats", """SELECT f.member_id, f.lo AS min_score, f.hi AS max_score, round(c.clarity, 3) AS clarity, a.correct, a.n - a.correct AS errors, a.acc
FROM (SELECT member_id, min(score) AS lo, max(score) AS hi FROM c_fact GROUP BY member_id) f JOIN c_clarity c USING (member_id) JOIN c_acc a USING (member_id)""")
def _(spark, d):
    fact = cut(_fact(spark, d))
    return sc.member_stats(fact).withColumn("clarity", F.round("clarity", 3))


@query("vote_threshold", """SELECT sample_id, class_id, CAST(sum(score) AS BIGINT) AS score FROM c_fact WHERE member_id IN (
SELECT member_id FROM c_corpus_pred WHERE split = 'train' GROUP BY member_id HAVING count(*) FILTER (pred = label) * 100e0 / count(*) >= 15) GROUP BY ALL""")
def _(spark, d):
    scores = cut(data.corpus_scores(spark, d, None))
    trained = sc.accuracy(sc.predictions(scores.where("split = 'train'")), ["member_id"]).where("acc >= 15")
    voting = scores.where("split = 'eval'").join(trained.select("member_id"), "member_id", "left_semi")
    return sc.long(sc.ensemble_sum(voting, ["sample_id"]), ["sample_id"])


# --- reports -----------------------------------------------------------------------------------


def _sum_pred(where: str = "TRUE") -> str:
    return f"""SELECT sample_id, label, CAST(arg_max(class_id, s * 16 - class_id) AS INTEGER) AS pred FROM (
SELECT sample_id, label, class_id, CAST(sum(score) AS BIGINT) AS s FROM c_fact WHERE {where} GROUP BY ALL) GROUP BY sample_id, label"""


def _ensemble_preds(spark, d, where: str | None = None):
    fact = _fact(spark, d)
    return sc.predictions(sc.ensemble_sum(fact.where(where) if where else fact, ["sample_id", "label"]))


@query("confusion", f"""SELECT label, pred, count(*) AS n, count(*) * 100e0 / max(total) AS pct, max(total - ok) * 100e0 / max(total) AS err_pct FROM (
SELECT *, count(*) OVER (PARTITION BY label) AS total, count(*) FILTER (pred = label) OVER (PARTITION BY label) AS ok FROM ({_sum_pred()})) GROUP BY label, pred""")
def _(spark, d):
    return rp.confusion(_ensemble_preds(spark, d))


@query("class_recall", f"""SELECT *, avg(recall) OVER (PARTITION BY member_id) AS avg_recall FROM (
SELECT member_id, label, count(*) FILTER (pred = label) AS correct, count(*) AS n, count(*) FILTER (pred = label) * 100e0 / count(*) AS recall FROM (
SELECT member_id, label, pred FROM c_pred UNION ALL SELECT CAST(-1 AS BIGINT), label, pred FROM ({_sum_pred()})) GROUP BY member_id, label)""")
def _(spark, d):
    return rp.class_recall(cut(_fact(spark, d)))


@query("errors_by_class", f"SELECT label, sample_id, pred FROM ({_sum_pred()}) WHERE label <> pred")
def _(spark, d):
    return rp.errors_by_class(_ensemble_preds(spark, d))


@query("score_checksum")
def _(spark, d):
    return rp.score_checksum(_fact(spark, d))


cte("c_rank", "SELECT member_id, row_number() OVER (ORDER BY spec, member_id) AS en FROM c_members")
cte("c_run", """SELECT r.en, f.member_id, f.sample_id, f.label, f.class_id,
 sum(f.score) OVER (PARTITION BY f.sample_id, f.class_id ORDER BY r.en ROWS UNBOUNDED PRECEDING) AS s,
 coalesce(sum(f.score) OVER (PARTITION BY f.sample_id, f.class_id ORDER BY r.en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM c_fact f JOIN c_rank r USING (member_id)""")
cte("c_curve", """SELECT en, member_id, correct, total, acc, acc - coalesce(lag(acc) OVER (ORDER BY en), 0) AS gain FROM (
SELECT en, member_id, count(*) FILTER (pred = label) AS correct, count(*) AS total, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM (
SELECT en, member_id, sample_id, label, arg_max(class_id, s * 16 - class_id) AS pred FROM c_run GROUP BY en, member_id, sample_id, label) GROUP BY en, member_id)""")


def _ordered(spark, d):
    """Scores with the columns of the member order (here: by spec, then id)."""
    return _fact(spark, d).join(data.corpus_members(spark).select("member_id", "spec"), "member_id")


def _curve(spark, d):
    return rp.with_curve_steps(rp.accuracy_curve(_ordered(spark, d), ["spec", "member_id"]), ["spec", "member_id"])


@query("en_curve", "SELECT * FROM c_curve")
def _(spark, d):
    return _curve(spark, d)


@query("en_best_prefix", "SELECT en AS best_en, correct, acc FROM c_curve ORDER BY correct DESC, en LIMIT 1")
def _(spark, d):
    return rp.best_prefix(_curve(spark, d))


@query("agreement", """SELECT member_id, count(*) FILTER (own = label AND ens <> label) AS agree, count(*) FILTER (own <> label AND ens = label) AS disagree FROM (
SELECT r.member_id, r.label, r.sample_id, arg_max(r.class_id, r.b * 16 - r.class_id) AS ens, max(p.pred) AS own FROM c_run r
JOIN c_pred p ON p.member_id = r.member_id AND p.sample_id = r.sample_id GROUP BY r.member_id, r.label, r.sample_id) GROUP BY member_id""")
def _(spark, d):
    return rp.agreement(_ordered(spark, d), ["spec", "member_id"])


@query("set_debug", """SELECT member_id, CAST(count(*) FILTER (pred = label) AS BIGINT) AS correct, CAST(count(*) FILTER (pred <> label) AS BIGINT) AS errors, count(*) FILTER (pred = label) * 100e0 / count(*) AS acc,
CAST(count(*) FILTER (pred = label AND label IN (1, 6)) AS BIGINT) AS target_correct, count(*) FILTER (pred = label AND label IN (1, 6)) * 100e0 / count(*) FILTER (label IN (1, 6)) AS target_acc FROM (
SELECT member_id, sample_id, label, arg_max(class_id, s * 16 - class_id) AS pred FROM (
 SELECT member_id, sample_id, label, class_id, sum(score) OVER (PARTITION BY sample_id, class_id ORDER BY member_id ROWS UNBOUNDED PRECEDING) AS s
 FROM c_fact WHERE member_id IN (0, 5, 9, 14, 20)) GROUP BY ALL) GROUP BY member_id""")
def _(spark, d):
    chosen = _fact(spark, d).where("member_id IN (0, 5, 9, 14, 20)")
    return rp.set_table(chosen, ["member_id"], [1, 6]).drop("spec")


@query("eval_set", f"""SELECT CAST(count(*) FILTER (pred = label) AS BIGINT) AS correct, CAST(count(*) FILTER (pred <> label) AS BIGINT) AS errors,
count(*) FILTER (pred = label) * 100e0 / count(*) AS acc FROM ({_sum_pred('member_id IN (0, 5, 9)')})""")
def _(spark, d):
    return sc.accuracy(_ensemble_preds(spark, d, "member_id IN (0, 5, 9)"), [])


# --- one search level, checked in SQL ------------------------------------------------------------

SLOTS = [(0, 5), (5, 9), (14,)]
cte("c_slots", "SELECT CAST(slot AS INTEGER) AS slot, CAST(member_id AS BIGINT) AS member_id FROM (VALUES "
    + ", ".join(f"({i}, {m})" for i, s in enumerate(SLOTS) for m in s) + ") AS t(slot, member_id)")
cte("c_slot_sums", "SELECT s.slot, f.sample_id, f.class_id, CAST(sum(f.score) AS BIGINT) AS base FROM c_slots s JOIN c_fact f USING (member_id) GROUP BY ALL")


def _level_sql(sums: str, outside: str) -> str:
    return f"""SELECT slot, member_id, CAST(count(*) FILTER (pred = label) AS BIGINT) AS correct, CAST(sum(margin) AS BIGINT) AS margin FROM (
SELECT slot, member_id, sample_id, label, arg_max(class_id, s * 16 - class_id) AS pred, max(s) - list_extract(list_sort(list(s), 'DESC'), 2) AS margin FROM (
SELECT b.slot, f.member_id, f.sample_id, f.label, f.class_id, b.base + f.score AS s FROM c_fact f JOIN {sums} b
ON b.sample_id = f.sample_id AND b.class_id = f.class_id WHERE {outside}) GROUP BY slot, member_id, sample_id, label) GROUP BY slot, member_id"""


def _pool(spark, d, goal: se.Goal = se.Goal(), keep: bool = False):
    return se.Pool(cut(_fact(spark, d), "scores"), goal, keep=keep)


@query("greedy_step", _level_sql("(SELECT 0 AS slot, sample_id, class_id, CAST(sum(score) AS BIGINT) AS base FROM c_fact WHERE member_id IN (0, 5) GROUP BY ALL)", "f.member_id NOT IN (0, 5)"))
def _(spark, d):
    return _pool(spark, d).candidates([(0, 5)])


@query("beam_level", _level_sql("c_slot_sums", "NOT EXISTS (SELECT 1 FROM c_slots x WHERE x.slot = b.slot AND x.member_id = f.member_id)"))
def _(spark, d):
    return _pool(spark, d).candidates(SLOTS)


_beam = _level_sql("c_slot_sums", "NOT EXISTS (SELECT 1 FROM c_slots x WHERE x.slot = b.slot AND x.member_id = f.member_id)")


@query("beam_cut", f"""SELECT array_to_string(members, ',') AS members, correct FROM (SELECT *, row_number() OVER (PARTITION BY members ORDER BY correct DESC, margin DESC, member_id, slot) AS rn FROM (
SELECT l.slot, l.member_id, l.correct, l.margin, list_sort(list_append(s.ms, l.member_id)) AS members FROM ({_beam}) l
JOIN (SELECT slot, list(member_id) AS ms FROM c_slots GROUP BY slot) s ON s.slot = l.slot)) WHERE rn = 1
ORDER BY correct DESC, margin DESC, member_id, slot LIMIT 5""")
def _(spark, d):
    slots = [se.Slot(s) for s in SLOTS]
    rows = se.beam_cut(se.expansions(_pool(spark, d).candidates(SLOTS), slots), 5)
    return rows.select(F.array_join("members", ",").alias("members"), "correct")


@query("swap_pass", """SELECT CAST(out_id AS BIGINT) AS out_id, member_id AS in_id, correct FROM (""" + _level_sql(
    """(SELECT o.out_id AS slot, f.sample_id, f.class_id, CAST(sum(f.score) AS BIGINT) AS base FROM c_fact f, (SELECT unnest([0, 5, 9]) AS out_id) o
WHERE f.member_id IN (0, 5, 9) AND f.member_id <> o.out_id GROUP BY ALL)""", "f.member_id NOT IN (0, 5, 9)").replace("SELECT slot, member_id, CAST(count", "SELECT slot AS out_id, member_id, CAST(count") + ")")
def _(spark, d):
    return se.swap_candidates(_pool(spark, d), [0, 5, 9])


# --- whole searches -----------------------------------------------------------------------------------


def _result(spark, found: se.SearchResult):
    return spark.createDataFrame([(sorted(found.members), found.correct, found.total)],
                                 "members ARRAY<LONG>, correct LONG, total LONG")


def _search(name: str, run) -> None:
    @query(name)
    def _(spark, d):
        pool = _pool(spark, d, getattr(run, "goal", se.Goal()), keep=True)
        try:
            return _result(spark, run(pool))
        finally:
            pool.close()


def _targeted(pool: se.Pool) -> se.SearchResult:
    return se.beam(pool, 3)


_targeted.goal = se.Goal((1, 6))

_search("greedy", lambda p: se.greedy(p))
_search("greedy_block", lambda p: se.greedy(p, min_gain=1.5, block=3))
_search("greedy_clarity", lambda p: se.greedy(p, clarity=sc.clarity(p.scores), max_members=4))
_search("beam", lambda p: se.beam(p, 3))
_search("beam_block", lambda p: se.beam(p, 3, min_gain=1.5, block=2))
_search("beam_restarts", lambda p: se.beam_restarts(p, 2, 2, lock=True))
_search("beam_seeded", lambda p: se.beam(p, 2, start=[(5,)]))
_search("beam_from_set", lambda p: se.beam(p, 2, start=[(0, 5, 9)], max_members=6))
_search("beam_marginal", lambda p: se.beam(p, 2, order="marginal", max_members=4))
_search("beam_clarity", lambda p: se.beam(p, 2, order="clarity", clarity=sc.clarity(p.scores), max_members=4))
_search("beam_target", _targeted)
_search("swap_search", lambda p: se.swap_search(p, [0, 5, 9], 3))
