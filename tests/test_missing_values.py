"""Every operator on numbers sees NaN as it sees null."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import aggregates, associate, detectors, gram, joint, kendall, profile, ranking

NUMS = ["a", "b"]

OPERATORS = {
    "exact_quantiles": lambda d: ranking.exact_quantiles(d, NUMS, [0.1, 0.5, 0.9]),
    "quantiles_wide": lambda d: ranking.quantiles_wide(d, NUMS, {"m": 0.5}),
    "quantile_ranks": lambda d: ranking.quantile_ranks(d, ["k"], NUMS),
    "wide_ranks": lambda d: ranking.wide_ranks(d, ["k"], NUMS),
    "z_scores": lambda d: profile.z_scores(d, NUMS, ["k"], 2.0),
    "standardize": lambda d: profile.standardize(d, NUMS, ["k"]),
    "iqr_fences": lambda d: profile.iqr_fences(d, NUMS),
    "iqr_stats": lambda d: profile.iqr_stats(d, NUMS),
    "box_stats": lambda d: profile.box_stats(d, NUMS),
    "describe_numeric": lambda d: profile.describe_numeric(d, NUMS),
    "histogram": lambda d: profile.histogram(d, NUMS, 10),
    "grid_density": lambda d: profile.grid_density(d, "a", "b", 5),
    "hex_density": lambda d: profile.hex_density(d, "a", "b", 8),
    "column_stats": lambda d: aggregates.column_stats(d, NUMS),
    "value_shares": lambda d: aggregates.value_shares(d, "a", 5),
    "child_stats": lambda d: aggregates.child_stats(d, ["g"], "a", "x"),
    "item_means": lambda d: aggregates.item_means(d, ["g"], "h", "a"),
    "pivot_items": lambda d: aggregates.pivot_items(d, ["g"], "h", "a", "x"),
    "pearson": lambda d: associate.corr_matrix(d, NUMS),
    "covariance": lambda d: gram.pearson_pairs(d, NUMS),
    "spearman": lambda d: associate.corr_matrix(d, NUMS, "spearman", ["k"]),
    "kendall": lambda d: kendall.kendall_pairs(d, NUMS),
    "anova_f": lambda d: associate.anova_f(d, ["g", "h"], NUMS),
    "kruskal_h": lambda d: associate.kruskal_h(d, ["g", "h"], NUMS),
    "mutual_information": lambda d: joint.mutual_information(d, NUMS, 6, min_rows=10),
    "mutual_information_quantile": lambda d: joint.mutual_information(d, NUMS, 5, "quantile", min_rows=10),
    "self_information": lambda d: joint.self_information(d, NUMS),
    "self_variance": lambda d: joint.self_information(d, NUMS, "variance"),
    "mutual_information_matrix": lambda d: joint.mutual_information_matrix(d, NUMS, "variance"),
    "joint_stats": lambda d: joint.joint_stats(d, NUMS, ["k"], min_rows=10),
    "score_threshold": lambda d: detectors.score_threshold(d, "a", 0.9),
    "quantile_flags": lambda d: detectors.quantile_flags(d, "a", 0.9),
    "mahalanobis": lambda d: detectors.mahalanobis(d, ["k"], NUMS),
}


@pytest.fixture(scope="module")
def holes(spark):
    """The same rows twice: missing values as null, and as NaN."""
    rng = np.random.default_rng(12)
    n = 300
    a, b = np.round(rng.normal(size=n), 1), rng.integers(0, 9, n).astype(float)
    a[rng.random(n) < 0.25], b[rng.random(n) < 0.2] = np.nan, np.nan
    g = rng.choice(["x", "y", "z"], n).tolist()
    h = [None if v < 0.2 else "p" if v < 0.6 else "q" for v in rng.random(n).tolist()]
    rows = [(i, float(x), float(y), u, v) for i, (x, y, u, v) in enumerate(zip(a, b, g, h))]
    nan = spark.createDataFrame(rows, "k int, a double, b double, g string, h string").cache()
    return nan.withColumns({c: F.nanvl(c, F.lit(None)) for c in NUMS}).cache(), nan


def rows_of(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple((c, repr(plain(r[c]))) for c in sorted(df.columns)) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nan_counts_as_null(holes, name):
    null, nan = holes
    got, want = rows_of(OPERATORS[name](nan)), rows_of(OPERATORS[name](null))
    assert got == want and got and "'nan'" not in str(got)


def test_ranks_with_gaps_equal_pandas(spark):
    """Several rankings at once: hot values, gaps, numbers beyond 2**53 and categories with nulls."""
    rng = np.random.default_rng(4)
    n = 2000
    pdf = pd.DataFrame({"a": np.where(rng.random(n) < 0.5, 7.0, rng.normal(size=n).round(2)), "b": rng.integers(0, 40, n).astype(float), "c": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    big = 2**60 + rng.integers(0, 30, n)
    df = spark.createDataFrame([(i, *map(float, r), int(x)) for i, (r, x) in enumerate(zip(pdf.itertuples(index=False), big))], "k int, a double, b double, c double, big long")
    got = {(r.x, r.y): (r.r, r.n) for r in associate.corr_matrix(df, ["a", "b", "c"], "spearman", ["k"]).collect()}
    want = pdf.corr("spearman")
    for (x, y), (r, m) in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-9) and m == len(pdf[[x, y]].dropna())
    ranks = ranking.wide_ranks(df, ["k"], ["big", "a"]).toPandas().sort_values("k")
    assert np.allclose(ranks["big"], pd.Series(big).rank()) and np.allclose(ranks["a"], pdf["a"].rank(), equal_nan=True)


def test_kruskal_equals_its_formula(spark):
    rng = np.random.default_rng(6)
    n = 900
    v = np.where(rng.random(n) < 0.3, 2.0, rng.normal(size=n).round(1))
    g = rng.integers(0, 4, n)
    h = np.where(rng.random(n) < 0.2, -1, rng.integers(0, 3, n))
    df = spark.createDataFrame([(float(x), str(a), None if b < 0 else str(b)) for x, a, b in zip(v, g, h)], "v double, g string, h string")
    got = {r.cat: r for r in associate.kruskal_h(df, ["g", "h"], ["v"]).collect()}
    for name, level in (("g", g), ("h", h)):
        x, lv = pd.Series(v[level >= 0]), level[level >= 0]
        rank, m = x.rank(), len(x)
        raw = 12 / (m * (m + 1)) * sum(rank[lv == k].sum() ** 2 / (lv == k).sum() for k in set(lv)) - 3 * (m + 1)
        ties = x.value_counts()
        want = raw / (1 - (ties**3 - ties).sum() / (m**3 - m))
        assert got[name].h == pytest.approx(want) and got[name].n == m and got[name].groups == len(set(lv))


def test_a_repeated_key_raises(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 3.0, None), (2, 4.0, 5.0)], "k int, v double, w double")
    with pytest.raises(Exception, match="more than one row"):
        ranking.wide_ranks(df, ["k"], ["v"]).collect()
