"""Invariants of the exact samplers: sizes exact, strata kept,
folds balanced, one stratum holding most rows still spread over buckets."""

from pyspark.sql import functions as F

from mailguard.operators import sampling as SM


def frame(spark, n=1000):
    # one hot stratum with 60 % of the rows
    return spark.range(n).select(F.col("id").cast("string").alias("key"),
                                 F.when(F.col("id") % 10 < 6, "hot")
                                 .otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string")))
                                 .alias("stratum"))


def test_stratified_split_exact(spark):
    out = SM.stratified_split(frame(spark), ["stratum"], 0.3, "key")
    got = {(r["stratum"], r["split"]): r["count"] for r in out.groupBy("stratum", "split").count().collect()}
    assert got[("hot", "test")] == 180 and got[("hot", "train")] == 420
    for s in ("s6", "s7", "s8", "s9"):
        assert got[(s, "test")] == 30


def test_stratified_sample_n_exact(spark):
    out = SM.stratified_sample_n(frame(spark), ["stratum"], 77, "key")
    assert out.filter("_selected").count() == 77


def test_kfold_balanced(spark):
    out = SM.kfold(frame(spark), ["stratum"], 5, "key")
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert sorted(sizes) == [200] * 5
    hot = [r["count"] for r in out.filter("stratum = 'hot'").groupBy("fold").count().collect()]
    assert sorted(hot) == [120] * 5


def test_per_group_sample_and_simple(spark):
    out = SM.per_group_sample(frame(spark), "stratum", 7, "key")
    assert all(r["count"] == 7 for r in out.groupBy("stratum").count().collect())
    assert SM.simple_sample(frame(spark), 13, "key").count() == 13
    # deterministic: same seed, same rows
    a = {r["key"] for r in SM.simple_sample(frame(spark), 13, "key").collect()}
    b = {r["key"] for r in SM.simple_sample(frame(spark), 13, "key").collect()}
    assert a == b


def with_nulls(spark, n=100):
    """A quarter of the rows has no stratum."""
    return spark.range(n).select(F.col("id").cast("string").alias("key"),
                                 F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), (F.col("id") % 4).cast("string")))
                                 .alias("stratum"))


def test_null_strata_lose_no_row(spark):
    df = with_nulls(spark)
    folds = SM.kfold(df, ["stratum"], 5, "key").collect()
    assert len(folds) == 100 and {r["fold"] for r in folds} == set(range(5))
    assert sorted(r["fold"] for r in folds if r["stratum"] is None) == sorted(list(range(5)) * 5)
    assert SM.stratified_sample_n(df, ["stratum"], 20, "key").filter("_selected").count() == 20
    split = SM.stratified_split(df, ["stratum"], 0.2, "key")
    assert split.filter("split = 'test' AND stratum IS NULL").count() == 5
    assert split.count() == 100 and split.columns == ["key", "stratum", "split"]
    assert SM.per_group_sample(df, "stratum", 3, "key").filter("stratum IS NULL").count() == 3


def test_null_target_has_no_label(spark):
    from mailguard.operators import models as ML
    df = spark.createDataFrame([("malicious",), ("benign",), (None,)], "target_1 string")
    assert [r["label"] for r in ML.with_label(df).collect()] == [1.0, 0.0, None]
