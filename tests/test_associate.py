import math

import numpy as np
import pandas as pd
import pytest

from tabloom.functions import pvalues
from tabloom.operators import associate as S
from tabloom.operators import joint
from tabloom.operators.kendall import weighted_inversions


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    rows = [(i, *[None if c[i] is None else float(c[i]) for c in cols.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in cols))


def pick(df, x, y, value):
    return df.where(f"x = '{x}' AND y = '{y}'").first()[value]


def brute_tau(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())


def test_spearman_ranks_again_on_shared_rows(spark):
    df = frame(spark, a=[1, 2, 3, 4, 4], b=[2, None, 7, 1, 9])
    assert pick(S.corr_matrix(df, ["a", "b"], "spearman", ["k"]), "a", "b", "r") == pytest.approx(0.1054093, abs=1e-6)


def test_constant_column_has_no_correlation(spark):
    df = frame(spark, a=[0.1] * 39 + [None], b=range(40))
    for method in ("pearson", "spearman", "kendall"):
        assert pick(S.corr_matrix(df, ["a", "b"], method, ["k"]), "a", "b", "r") is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_equals_pandas(spark, method):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=500) + 1e6, "b": rng.integers(0, 5, 500).astype(float)})
    pdf["c"] = pdf.a * 2 + rng.normal(size=500)
    pdf.loc[rng.random(500) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(500) < 0.1, "c"] = np.nan
    df = frame(spark, **{c: [None if np.isnan(v) else v for v in pdf[c]] for c in pdf})
    got = S.corr_matrix(df, list(pdf), method, ["k"]).collect()
    want = pdf.corr(method)
    assert len(got) == 6
    for r in got:
        assert r.r == pytest.approx(want.loc[r.x, r.y], abs=1e-9)
        assert r.n == pdf[[r.x, r.y]].dropna().shape[0]


def test_inversions_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y, w = rng.integers(0, 6, 40), rng.integers(0, 6, 40), rng.integers(1, 4, 40).astype(float)
        want = sum(
            w[i] * w[j] for i in range(40) for j in range(40) if x[i] < x[j] and y[i] > y[j]
        )
        assert weighted_inversions(x, y, w) == want


def test_kendall_with_hot_values_and_many_ranges(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(600) < 0.4, 3.0, rng.integers(0, 50, 600))
    y = np.where(rng.random(600) < 0.35, 1.0, x + rng.integers(-9, 9, 600))
    df = frame(spark, x=x, y=y)
    for limit, most in ((1000, 256), (150, 256), (40, 4), (8, 3)):  # whole, one level, several levels of ranges
        got = S.kendall_pairs(df, ["x", "y"], limit, most).first()
        assert got.tau == pytest.approx(brute_tau(x, y), abs=1e-12) and got.n == 600


def test_kendall_tree_of_ranges_over_several_pairs(spark):
    """Small groups forced at every level: continuous, few-valued and constant columns and gaps."""
    rng = np.random.default_rng(8)
    n = 500
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.ones(n)})
    pdf["d"] = pdf.a + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.2, "d"] = np.nan
    df = frame(spark, **{c: [None if np.isnan(v) else v for v in pdf[c]] for c in pdf})
    got = {(r.x, r.y): r for r in S.kendall_pairs(df, list(pdf), 30, 4).collect()}
    assert len(got) == 6
    for (x, y), r in got.items():
        both = pdf[[x, y]].dropna()
        assert r.n == len(both)
        if "c" in (x, y):
            assert r.tau is None
        else:
            assert r.tau == pytest.approx(brute_tau(both[x].to_numpy(), both[y].to_numpy()), abs=1e-12)


def cats(spark, x, y):
    return spark.createDataFrame(list(zip(x, y)), "x string, y string")


def test_cramers_v_yates_and_bias(spark):
    df = cats(spark, "a" * 30 + "b" * 30, "p" * 25 + "q" * 5 + "p" * 10 + "q" * 20)
    o = np.array([[25, 5], [10, 20]], float)
    e = np.outer(o.sum(1), o.sum(0)) / 60
    chi2 = (((np.abs(o - e) - 0.5) ** 2) / e).sum()
    phi2 = max(0.0, chi2 / 60 - 1 / 59)
    want = math.sqrt(phi2 / (2 - 1 / 59 - 1))
    assert S.cramers_v_matrix(df, ["x", "y"]).first().v == pytest.approx(want)
    plain = math.sqrt((((o - e) ** 2) / e).sum() / 60)
    assert S.cramers_v_matrix(df, ["x", "y"], False, False).first().v == pytest.approx(plain)


def test_categorical_edges(spark):
    same = cats(spark, ["a"] * 5, ["p", "q", "p", "q", None])
    assert S.cramers_v_matrix(same, ["x", "y"]).first().v is None
    u = {(r.x, r.y): r.u for r in S.theils_u_matrix(same, ["x", "y"]).collect()}
    assert u[("x", "y")] == 1.0 and u[("y", "x")] == pytest.approx(0.0) and u[("x", "x")] == 1.0
    null_level = S.contingency_table(same, ["x", "y"])
    assert null_level.where("y_level = '0.0'").first().n == 1


def test_theils_u_is_one_when_determined(spark):
    df = cats(spark, "aabbcc", "ppqqqq")
    u = {(r.x, r.y): r.u for r in S.theils_u_matrix(df, ["x", "y"]).collect()}
    assert u[("y", "x")] == pytest.approx(1.0) and u[("x", "y")] < 1.0


def test_anova_and_kruskal_closed_forms(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    f = S.anova_f(df, ["g"], ["v"]).first()
    assert f.groups == 2 and f.n == 6 and f.f == pytest.approx(2.4) and f.p == pytest.approx(0.19626, abs=1e-5)
    k = S.kruskal_h(df, ["g"], ["v"]).first()
    ranks = {"a": 1 + 2.5 + 4, "b": 2.5 + 5 + 6}
    h = (12 / 42 * sum(r * r / 3 for r in ranks.values()) - 21) / (1 - 6 / 210)
    assert k.h == pytest.approx(h) and k.p == pytest.approx(math.erfc(math.sqrt(h / 2)), rel=1e-9)


def test_single_group_is_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert S.anova_f(df, ["g"], ["v"]).count() == 0 and S.kruskal_h(df, ["g"], ["v"]).count() == 0


def test_p_values_against_commons_math(spark):
    dist = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for d1, d2, x in ((1, 5, 0.3), (2, 50, 3.0), (9, 4000, 1.2), (30, 7, 8.0)):
        want = 1.0 - dist.FDistribution(float(d1), float(d2)).cumulativeProbability(x)
        assert pvalues.f_survival(x, d1, d2) == pytest.approx(want, abs=1e-8)
    for k, x in ((1, 0.2), (2, 5.99), (9, 30.0), (50, 40.0)):
        want = 1.0 - dist.ChiSquaredDistribution(float(k)).cumulativeProbability(x)
        assert pvalues.chi2_survival(x, k) == pytest.approx(want, abs=1e-8)


def ksg(x, y, k=3):
    dx, dy = np.abs(np.subtract.outer(x, x)), np.abs(np.subtract.outer(y, y))
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    radius = np.nextafter(np.sort(d, axis=1)[:, k - 1], 0)[:, None]
    psi = joint.digamma_int
    marginal = psi((dx <= radius).sum(1)) + psi((dy <= radius).sum(1))
    return psi(np.array([len(x), k])).sum() - marginal.mean()


def test_ksg_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = x + 0.6 * rng.normal(size=400)
    df = frame(spark, x=x, y=y)
    got = joint.mutual_information(df, ["x", "y"], method="ksg", key=["k"]).first()
    assert got.mi == pytest.approx(ksg(x / x.std(), y / y.std()), abs=1e-6)


def test_mutual_information_needs_enough_rows(spark):
    df = frame(spark, a=range(50), b=range(50))
    assert joint.mutual_information(df, ["a", "b"]).first().mi is None
    assert joint.mutual_information(df, ["a", "b"], min_rows=10).first().mi > 2.0


def test_missing_values_have_no_bin(spark):
    df = frame(spark, a=[None, 0.0, 1.0, 2.0], b=[1.0, 1.0, 2.0, None])
    assert joint.mutual_information(df, ["a", "b"], 4, min_rows=1).first().n == 2
    entropy = joint.self_information(df, ["a"], bins=3).first().mi
    assert entropy == pytest.approx(math.log(3))


def test_top_pairs_are_unordered_and_fall_back(spark):
    df = frame(spark, a=range(30), b=[-v for v in range(30)], c=[1.0] * 30)
    pairs = S.corr_matrix(df, ["a", "b", "c"])
    assert joint.pairs_to_show(pairs, ["a", "b", "c"]) == [("a", "b")]
    flat = frame(spark, a=[1.0] * 9, b=[2.0] * 9)
    assert joint.pairs_to_show(S.corr_matrix(flat, ["a", "b"]), ["a", "b"]) == [("a", "b")]


@pytest.mark.parametrize("rows, cells", [(200_000, 2_000_000), (50, 40)])
def test_contingency_of_many_columns(spark, monkeypatch, rows, cells):
    """Sixty columns with nulls; a task sends no more rows than there are pairs of levels."""
    monkeypatch.setattr(S, "COUNTED_ROWS", rows)
    monkeypatch.setattr(S, "HELD_CELLS", cells)
    rng = np.random.default_rng(5)
    cols = [f"v{i}" for i in range(60)]
    pdf = pd.DataFrame({c: rng.choice(["a", "b", "c", None], 400) for c in cols})
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], ", ".join(f"{c} string" for c in cols)).repartition(2)
    got = S.contingency(df, cols, None).collect()
    assert len(got) == 1770 * 9 and len({(r.i, r.j) for r in got}) == 1770
    want = {k: dict(pdf.groupby([cols[k[0]], cols[k[1]]]).size()) for k in [(0, 1), (3, 59), (40, 41)]}
    for (i, j), table in want.items():
        assert {(r.vx, r.vy): r.o for r in got if (r.i, r.j) == (i, j)} == table
    filled = S.contingency(df, cols[:2], "0.0").collect()
    assert sum(r.o for r in filled) == 400 and {r.vx for r in filled} == {"a", "b", "c", "0.0"}


def test_kendall_rows_do_not_carry_the_edges_of_their_group(spark):
    from tabloom.operators import kendall

    points = spark.range(4000).selectExpr(
        "CAST(id % 2 AS int) AS pair", "CAST(0 AS long) AS part", "CAST(id * 7919 % 4001 AS double) AS first", "CAST(id AS double) AS second", "1D AS c"
    )
    groups = points.groupBy("pair", "part").count().withColumnRenamed("count", "n")
    cut = kendall._split(points, groups, 100, 16)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and cut.count() == 4000
    assert cut.agg({"bx": "max"}).first()[0] == 15


def test_ranks_get_more_tasks_with_more_cells(spark, monkeypatch):
    from tabloom.operators import ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    df = spark.range(2000).selectExpr("id AS k", "CAST(id * 7919 % 2003 AS double) AS a", "CAST(id % 7 AS double) AS b")
    wide = ranking.wide_ranks(df, ["k"], ["a", "b"])
    assert wide.rdd.getNumPartitions() == 60  # 2,000 rows, two cells and a mark each
    got = wide.toPandas().set_index("k").sort_index()
    pdf = df.toPandas().set_index("k")
    assert np.allclose(got, pdf.rank())


@pytest.mark.parametrize("together", [32, 1])
def test_a_column_is_sorted_once_for_its_partners(spark, monkeypatch, together):
    from pyspark.sql import functions as F

    from tabloom.operators import associate, ranking

    monkeypatch.setattr(associate, "TOGETHER", together)
    rng = np.random.default_rng(2)
    n = 400
    big = [int(2**60 + v) for v in rng.integers(0, 40, n)]
    pdf = pd.DataFrame(
        {"k": np.arange(n), "a": np.where(rng.random(n) < 0.3, None, rng.integers(0, 9, n) * 1.0), "hot": np.where(rng.random(n) < 0.8, 0.0, rng.random(n)),
         "c": np.where(rng.random(n) < 0.2, None, rng.random(n)), "big": big, "none": None}
    ).astype({"a": float, "c": float, "none": float})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, a double, hot double, c double, big long, none double")
    cols = ["a", "hot", "c", "big", "none"]
    got = {(r.x, r.y): (r.r, r.n) for r in associate.spearman_pairs(df, ["k"], cols).collect()}
    assert len(got) == 15 and got["a", "none"] == (None, 0)
    pdf["big"] = [v - 2**60 for v in big]
    for i, x in enumerate(cols[:4]):
        for y in cols[i:4]:
            both = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
            want = 1.0 if x == y else both[x].rank().corr(both[y].rank())
            assert got[x, y][0] == pytest.approx(want, abs=1e-9) and got[x, y][1] == len(both)
    partners = ["a", "c", "hot"]
    cells = ranking.ranked_together(df, [(x, [F.col(x).isNotNull() & F.col(y).isNotNull() for y in partners if y != x]) for x in partners], ["k"])
    # one cell for each value with a partner in its row, not one for each pair
    assert cells.count() == sum(int((pdf[x].notna() & pdf[[y for y in partners if y != x]].notna().any(axis=1)).sum()) for x in partners)
    with pytest.raises(Exception, match="names more than one row"):
        associate.spearman_pairs(df.union(df), ["k"], ["a", "c"]).collect()
