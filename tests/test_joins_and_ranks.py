import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregates as A
from tabloom.operators import joins as J
from tabloom.operators import profile, ranking


def test_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert {(r.k, r.b) for r in J.left_join(a, b, "k").collect()} == {(1, "p"), (None, None)}
    assert {(r.k, r.b) for r in J.left_join(a, b, "k", null_keys_match=True).collect()} == {(1, "p"), (None, "q")}
    assert A.child_counts(b, ["k"], "t").count() == 1


def test_single_row_group_has_no_std(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert A.child_stats(df, ["k"], "v", "t").first().t_std is None


def test_pivot_ties_and_empty_items(spark):
    rows = [(k, f"i{n:02d}", float(k)) for k in range(2) for n in range(51)]
    df = spark.createDataFrame(rows, "k int, item string, v double")
    wide = A.pivot_items(df, ["k"], "item", "v", "T", 50)
    assert len(wide.columns) == 51 and "T_item_i50" not in wide.columns
    empty = spark.createDataFrame([(1, "a", None), (1, "a", None), (1, "b", 2.0)], "k int, item string, v double")
    assert A.pivot_items(empty, ["k"], "item", "v", "T").columns == ["k", "T_item_b"]
    assert len(A.pivot_items(empty, ["k"], "item", "v", "T", drop_empty=False).columns) == 3


def test_outer_combine_names_and_zip(spark):
    a = spark.createDataFrame([(1, 10)], "k int, v int")
    b = spark.createDataFrame([(2, 20)], "k int, v int")
    c = spark.createDataFrame([(1, 30)], "k int, v int")
    out = J.outer_combine({"a": a, "b": b, "c": c}, [["k"]])
    assert out.columns == ["k", "v", "v_b", "v_c"]
    assert {tuple(r) for r in out.collect()} == {(1, 10, None, 30), (2, None, 20, None)}
    with pytest.raises(ValueError):
        J.outer_combine({"a": a, "d": spark.createDataFrame([(1,)], "z int")}, [["k"]])


def test_skew_safe_join_with_hot_and_null_keys(spark):
    big = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("k")
    )
    small = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = J.skew_safe_left_join(big, small, ["k"], ["id"], J.hot_keys(big, ["k"], 4))
    plain = big.join(small, "k", "left").select("id", "k", "v")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_percentile_ranks_with_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 4.0, None])], "k int, v double")
    got = {r.k: r.v for r in ranking.quantile_ranks(df, ["k"], ["v"]).collect()}
    assert got == {0: 20.0, 1: 40.0, 2: 60.0, 3: 90.0, 4: 90.0, 5: None}


def test_ranks_equal_pandas_on_skewed_values(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(4000) < 0.4, 5.0, np.round(rng.lognormal(1.5, 1.0, 4000), 2))
    v[rng.random(4000) < 0.1] = np.nan
    pdf = pd.DataFrame({"k": np.arange(4000), "v": v, "w": rng.normal(size=4000)})
    got = ranking.quantile_ranks(
        spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))), ["k"], ["v", "w"]
    ).toPandas().sort_values("k")
    for c in ("v", "w"):
        want = pdf[c].rank(pct=True) * 100
        assert np.allclose(got[c].to_numpy(float), want, equal_nan=True)


@pytest.mark.parametrize("in_one_task", [5_000_000, 10])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(ranking, "BRACKET_ROWS", in_one_task)
    rng = np.random.default_rng(1)
    x = np.r_[np.zeros(900), rng.normal(size=1101)]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {r.prob: r.quantile for r in ranking.exact_quantiles(df, ["x"], probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(x, probs))


def test_positions_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("o")).repartition(5)
    got = {r.o: r.position for r in ranking.row_positions(df, "o").collect()}
    assert all(got[3 * i] == i for i in range(1000))


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 5.0, float(i)) for i in range(5)], "k int, same double, v double")
    assert profile.z_scores(df, ["same", "v"], ["k"]).columns == ["k", "v_zscore"]
    assert {r.same for r in profile.standardize(df, ["same"], ["k"]).collect()} == {0.0}
    assert profile.histogram(df, ["same"], 10).first().n == 5


def test_no_single_partition_window(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v"))
    plan = ranking.wide_ranks(df, ["id"], ["v"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
