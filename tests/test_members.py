import pytest
from pyspark.sql import functions as F

from bitquilt.operators import members as mb
from bitquilt.operators.rank import global_rank
from bitquilt.operators.quality import check_dup_specs
from bitquilt.sources import corpus as cp
from bitquilt.sources import vectors as sv


@pytest.fixture
def pool(spark):
    rows = [(1, "id:mnist:exp8", 50.0), (2, "rot22@avg4:lbp:sig16", 60.0), (3, "rot0@id:edge:exp", 60.0), (4, "hflip:R:inv-exp32", 10.0)]
    return spark.createDataFrame(rows, "member_id LONG, spec STRING, eval DOUBLE")


def ids(df):
    return sorted(r["member_id"] for r in df.collect())


def test_filters(pool):
    assert ids(mb.filter_members(pool, include=["ID:", "hflip"])) == [1, 3, 4]
    assert ids(mb.filter_members(pool, exclude=["exp"])) == [2]
    assert ids(mb.filter_members(pool, named=["t1"])) == [2, 3]
    assert ids(mb.filter_members(pool, regex=["^rot"], eval_gt=59.0, regex_exclude=["edge"])) == [2]
    assert ids(mb.filter_members(pool, include=["nothing"])) == []


def test_percentile_is_an_element(pool):
    assert ids(mb.filter_eval_percentile(pool, 50, "ge")) == [2, 3]
    assert ids(mb.filter_eval_percentile(pool, 100, "ge")) == [2, 3]
    assert ids(mb.filter_eval_percentile(pool, 0, "gt")) == [1, 2, 3]


def test_global_rank_with_one_hot_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"))
    ranked = global_rank(df, [F.col("k"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(3000))
    assert [(r["k"], r["id"]) for r in ranked] == sorted((r["k"], r["id"]) for r in ranked)


def test_global_rank_of_nothing(spark):
    assert global_rank(spark.range(0), [F.col("id")]).count() == 0


def test_spec_lookup_prefers_exact(spark, pool):
    wanted = spark.createDataFrame([("id:mnist:exp",), ("rot0@id:edge:exp",), ("rot22@avg4:lbp:sig1",), ("nope",)], "wanted STRING")
    got = {r["wanted"]: r["member_id"] for r in mb.find_spec(pool, wanted).collect()}
    assert got == {"id:mnist:exp": 1, "rot0@id:edge:exp": 3, "rot22@avg4:lbp:sig1": 2}


def test_parse_spec(pool):
    rows = {r["member_id"]: r for r in mb.parse_spec(pool).collect()}
    assert (rows[2]["encoding"], rows[2]["width"], rows[2]["steps"]) == ("sig", 16, ["rot22", "avg4"])
    assert (rows[3]["encoding"], rows[3]["width"]) == ("exp", 8)
    assert (rows[4]["encoding"], rows[4]["width"]) == ("inv-exp", 32)


def test_alias_expansion_agrees_with_driver(spark):
    for text in ("performance", "augmentation", "all-colswap@avg4", "sweep-fashion", "hflip"):
        df = spark.createDataFrame([(1, text)], "member_id LONG, xform STRING")
        rows = mb.expand_chains(df, "xform", mb.alias_table(spark, "xform")).collect()
        assert sorted(r["xform"] for r in rows) == sorted(mb.expand_xforms(text))


def test_dataset_alias_wins(spark):
    shared = mb.alias_table(spark, "encoding").where("name = 'ey-s-3'").first()["expansion"]
    own = mb.alias_table(spark, "encoding", "cifar").where("name = 'ey-s-3'").first()["expansion"]
    assert shared[-1] == "lbp-rb:exp" and own[-1] == "lbp-rg:cbrt"


def test_unknown_class_is_an_error(spark):
    df = spark.createDataFrame([(1, 0)], "sample_id LONG, label INT")
    with pytest.raises(ValueError):
        sv.filter_classes(df, ["truck"], ["bird", "cat"])


def test_split_is_clamped(spark):
    df = spark.range(10).select(F.col("id").alias("sample_id"), F.lit("train").alias("split"))
    rows = sv.split_samples(df, 8, 100).orderBy("sample_id").collect()
    assert [r["split"] for r in rows] == ["train"] * 8 + ["eval"] * 2


def test_split_ratio_keeps_one(spark):
    df = spark.range(100).select(F.when(F.col("id") < 1, "eval").otherwise("train").alias("split"), (F.col("id") % 10).cast("int").alias("label"))
    r = sv.split_ratio_kept(df, [1]).first()
    assert (r["kept_n"], r["new_eval"], r["new_train"]) == (10, 1, 9)


def test_manifest_states(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "name STRING, ctime LONG, size LONG")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "name STRING, ctime LONG, size LONG")
    assert {r["name"]: r["state"] for r in cp.manifest_diff(old, new).collect()} == {"a": "kept", "b": "changed", "c": "orphan", "d": "new"}


def test_only_changed_entries_are_read(spark, tmp_path):
    for name, n in (("a", 1), ("b", 2), ("c", 4)):
        spark.range(n).write.parquet(f"{tmp_path}/{name}")
    diff = spark.createDataFrame([("a", "kept"), ("b", "changed"), ("c", "new")], "name STRING, state STRING")
    assert cp.read_changed(spark, diff, str(tmp_path)).count() == 6
    assert cp.read_changed(spark, diff.where("state = 'kept'"), f"{tmp_path}/a").count() == 0


def test_scratch_folder_is_the_sessions(spark):
    from bitquilt.session import cut, discard, scratch_root

    stored = cut(spark.range(3))
    assert stored.count() == 3 and stored.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(scratch_root(spark).lstrip("/"))
    discard(stored)


def test_member_list_format(spark):
    lines = ["# Optimal subset", "", "rot0@avg4:mnist:inv-exp8  0xBDD73226", "  id:mnist:exp8", "#x"]
    df = spark.createDataFrame([(v,) for v in lines], "value STRING")
    assert [r["spec"] for r in cp.parse_member_list(df).collect()] == ["rot0@avg4:mnist:inv-exp8", "id:mnist:exp8"]


def test_fnv_ids(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "name STRING")
    got = {r["name"]: r["member_id"] & (2**64 - 1) for r in cp.fnv_ids(df).collect()}
    assert got == {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "foobar": 0x85944171F73967E8}


def test_duplicates(spark, pool):
    assert check_dup_specs(pool.union(pool.where("member_id = 1"))).first()["n"] == 2
