import pytest
from pyspark.sql import functions as F

from tabloom.functions import columns as C
from tabloom.functions import missing as M
from tabloom.functions import scalars as S
from tabloom.operators import rules, sampling


def test_nan_becomes_null(spark):
    df = M.normalize_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "a double"))
    assert df.agg(F.count("a"), F.avg("a")).first()[:] == (1, 1.0)


def test_missing_level_covers_null_and_nan_text(spark):
    df = spark.createDataFrame([("a",), (None,), ("nan",)], "c string")
    assert sorted(r[0] for r in df.select(M.missing_to_category("c")).collect()) == ["a", "missing", "missing"]


def test_missing_ratio_keeps_exactly_half(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 1.0, 2.0)], "k int, a double, b double")
    assert sorted(r.k for r in M.filter_missing_rows(df, ["a", "b"], 0.5).collect()) == [1, 3]
    assert M.filter_missing_rows(df, ["a", "b"], None).count() == 3
    assert M.missing_filter_report(df, ["a", "b"], 0.5).first().n_filtered == 1


def test_roles_and_bad_numeric(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "t")], "id int, c string, v double, note string")
    assert C.select_roles(df, ["c"], ["v"], ["id", "note"]) == (["v"], ["c"], ["v"])
    with pytest.raises(ValueError):
        C.select_roles(df, ["c"], [], ["id"])


def test_cardinality_caps(spark):
    df = spark.range(5000).select(
        F.concat(F.lit("a"), F.col("id") % 50).alias("fifty"),
        F.concat(F.lit("a"), F.col("id") % 51).alias("fifty_one"),
        F.col("id").cast("string").alias("wide"),
    )
    kept, skipped = C.low_cardinality_cols(df, ["fifty", "fifty_one", "wide"], 50)
    assert kept == ["fifty"] and skipped["fifty_one"] == 51 and skipped["wide"] > 4000


def test_validity_rules(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 1.0), (2.0, 1.0, None), (3.0, 1.0, None)], "ok double, same double, sparse double"
    )
    assert C.valid_columns(df, ["ok", "same", "sparse"]) == ["ok"]
    assert C.valid_columns(df, ["ok", "same"], None) == ["ok"]


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(S.half_even_long(F.col("v"))).collect()] == [2, 4, 0]
    assert [r[0] for r in df.select(S.clip(F.col("v"))).collect()] == [1.0, 1.0, -0.5]
    text = [str(r[0]) for r in df.select(S.rounded(F.rint("v"), 0)).collect()]
    assert "-0.0" not in text


def test_rules_use_word_boundaries(spark):
    df = spark.createDataFrame([(1, -5.0, 200, -1.0, 120.0)], "k int, percentage double, Age int, n_count double, bmi double")
    found = {(r["rule"], r["column"], r["n"]) for r in rules.rule_counts(df).collect()}
    assert found == {("negative", "n_count", 1), ("age_over_150", "Age", 1), ("bmi_over_100", "bmi", 1)}
    assert rules.rule_flags(df, ["k"]).first().has_violation == 1


def test_splits_and_samples_ignore_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = sampling.split_rows(df, ["k"]).groupBy("split").count().collect()
    b = sampling.split_rows(df.repartition(7), ["k"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in a} == {r.split: r["count"] for r in b}
    shares = {r.split: r["count"] / 5000 for r in a}
    assert abs(shares["train"] - 0.6) < 0.03 and abs(shares["test"] - 0.2) < 0.03
    one = sorted(r.k for r in sampling.sample_rows(df, ["k"], 700).collect())
    two = sorted(r.k for r in sampling.sample_rows(df.repartition(9), ["k"], 700).collect())
    assert one == two and len(one) == 700
    assert sampling.sample_rows(df, ["k"], 9000).count() == 5000


def test_drawn_labels_follow_probabilities(spark):
    drawn = sampling.draw_labels(spark.range(20000), "id", {"a": 0.7, "b": 0.3})
    share = drawn.where("label = 'a'").count() / 20000
    assert abs(share - 0.7) < 0.02
