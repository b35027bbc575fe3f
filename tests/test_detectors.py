import numpy as np
import pandas as pd
import pytest

from tabloom.operators import detectors, features, neighbors


def vectors(spark, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    return spark.createDataFrame(pd.DataFrame({"id": ids, "v": [list(map(float, r)) for r in x]}), "id long, v array<double>")


def brute(x, ids, k, metric="euclidean"):
    diff = x[:, None] - x[None]
    d = np.sqrt((diff**2).sum(2)) if metric == "euclidean" else np.abs(diff).max(2)
    rows = []
    for i in range(len(x)):
        near = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        rows += [(ids[i], ids[j], r + 1, d[i, j]) for r, j in enumerate(near)]
    return sorted(rows)


def check(spark, x, ids, k, metric="euclidean"):
    got = sorted((r.id, r.nbr, r.rk, r.dist) for r in neighbors.knn_graph(vectors(spark, x, ids), "id", "v", k, metric=metric).collect())
    want = brute(x, ids, k, metric)
    assert [g[:3] for g in got] == [tuple(w[:3]) for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_knn_with_many_copies_and_ties(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    x = np.vstack([np.full((150, 2), 3.0), rng.integers(0, 9, (250, 2)).astype(float)])
    check(spark, x, rng.permutation(400), 5, metric)


def test_knn_fewer_rows_than_neighbours(spark):
    check(spark, np.array([[0.0], [1.0], [5.0]]), np.array([2, 1, 0]), 4)


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    exact = {(r.id, r.nbr) for r in neighbors.knn_graph(e, "vec_id", "embedding", 5).collect()}
    rough = {(r.id, r.nbr) for r in neighbors.knn_graph(e, "vec_id", "embedding", 5, "ivf", probes=4).collect()}
    assert len(exact & rough) / len(exact) >= 0.95


def ring(n=150):
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return np.vstack([np.c_[np.cos(a), np.sin(a)], [[30.0, 30.0]]])


def test_far_point_ranks_first(spark):
    x = ring()
    df = vectors(spark, x)
    far = len(x) - 1
    wide = df.select("id", *[df["v"][i].alias(f"c{i}") for i in range(2)])
    m = detectors.mahalanobis(wide, ["id"], ["c0", "c1"]).toPandas().set_index("id").mahalanobis
    assert m.idxmax() == far
    matrix, _ = features.feature_matrix(wide, ["id"], ["c0", "c1"])
    knn = neighbors.knn_distance(matrix, "id").toPandas().set_index("id").knn_distance
    lof = neighbors.local_outlier_factor(matrix, "id").toPandas().set_index("id")
    iso = detectors.isolation_forest(matrix, ["id"]).toPandas().set_index("id")
    svm = detectors.one_class_svm(matrix, ["id"], rounds=8).toPandas().set_index("id")
    assert knn.idxmax() == far and lof.local_outlier_factor.idxmax() == far
    assert iso.isolation_forest.idxmin() == far and svm.one_class_svm.idxmin() == far
    for s in (lof.local_outlier_factor_outlier, iso.isolation_forest_outlier, svm.one_class_svm_outlier):
        assert s[far] == 1 and abs(s.mean() - 0.1) < 0.05


def test_mahalanobis_with_dependent_columns(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    pdf = pd.DataFrame({"k": np.arange(60), "a": x[:, 0], "b": x[:, 1], "c": x[:, 0] * 2, "one": 1.0})
    got = detectors.mahalanobis(spark.createDataFrame(pdf), ["k"], ["a", "b", "c", "one"]).toPandas().sort_values("k")
    z = pdf[["a", "b", "c"]].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    inv = np.linalg.pinv(np.cov(z.T))
    assert np.allclose(got.mahalanobis, np.sqrt(np.einsum("ij,jk,ik->i", z, inv, z)))
    assert detectors.mahalanobis(spark.createDataFrame(pdf), ["k"], ["a", "one"]) is None


def exact_svm_scores(x, nu):
    """Kernel scores from pairwise steps on the exact dual."""
    n = len(x)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1])
    a, cap = np.full(n, 1 / n), 1 / (nu * n)
    g = k @ a
    for _ in range(20000):
        i, j = np.where(a < cap - 1e-15, g, np.inf).argmin(), np.where(a > 1e-15, g, -np.inf).argmax()
        if g[j] - g[i] < 1e-8:
            break
        step = min((g[j] - g[i]) / (2 - 2 * k[i, j]), cap - a[i], a[j])
        a[i], a[j], g = a[i] + step, a[j] - step, g + step * (k[:, i] - k[:, j])
    return k @ a


def test_svm_is_close_to_the_exact_solution(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 3)), rng.normal(2, 0.5, size=(100, 3))])
    x = (x - x.mean(0)) / x.std(0)
    df = vectors(spark, x).withColumnRenamed("v", "features")
    got = detectors.one_class_svm(df, ["id"], components=1024).toPandas().sort_values("id")
    want = pd.Series(exact_svm_scores(x, 0.1))
    assert np.corrcoef(got.one_class_svm.rank(), want.rank())[0, 1] > 0.93
    assert (got.one_class_svm_outlier.to_numpy()[want.to_numpy() < want.quantile(0.1)] == 1).mean() > 0.7


def test_isolation_ignores_partitioning(spark):
    x = np.random.default_rng(2).normal(size=(300, 3))
    df = vectors(spark, x).withColumnRenamed("v", "features")
    a = detectors.isolation_forest(df, ["id"]).toPandas().sort_values("id").isolation_forest
    b = detectors.isolation_forest(df.repartition(5), ["id"]).toPandas().sort_values("id").isolation_forest
    assert np.allclose(a, b)


def test_lof_is_near_one_on_a_grid(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)], float)
    lof = neighbors.local_outlier_factor(vectors(spark, x), "id", "v", 8).toPandas().set_index("id").local_outlier_factor
    inner = [i * 12 + j for i in range(3, 9) for j in range(3, 9)]
    assert np.allclose(lof[inner], 1.0, atol=0.1)


def test_too_few_rows_give_no_knn_distance(spark):
    assert neighbors.knn_distance(vectors(spark, ring(20)), "id", "v").count() == 0


def test_pca_keeps_distances_of_a_plane(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) + 4.0
    out = features.pca_reduce(vectors(spark, x), ["id"], 2, "v").toPandas().sort_values("id")
    y = np.vstack(out.features)
    assert y.shape == (80, 2)
    assert np.allclose(np.linalg.norm(x[0] - x, axis=1), np.linalg.norm(y[0] - y, axis=1))


def test_consensus(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 0, 0), (3, 1, 1, 1)], "k int, a_outlier int, b_outlier int, c_outlier int")
    got = {r.k: r.consensus_outlier for r in detectors.consensus_outliers(df, ["k"]).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_intervals_merge():
    got = neighbors._merged(np.array([0.5, 0.0, 3.0, 9.0]), np.array([1.0, 0.6, 4.0, 10.0]), 5.0)
    assert got == [(0.0, 1.0), (3.0, 4.0)] and neighbors._merged(np.zeros(0), np.zeros(0), 1.0) == []


def test_probing_each_query_visits_its_own_cells(spark, monkeypatch):
    """Small blocks, several to a cell: all probes are exact, a few find nearly all neighbours."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) + 6 * rng.integers(0, 4, 400)[:, None]
    df = vectors(spark, x, list(range(400)))
    exact = {(r.id, r.nbr) for r in neighbors.knn_graph(df, "id", "v", 4).collect()}
    whole = {(r.id, r.nbr) for r in neighbors.knn_graph(df, "id", "v", 4, "ivf", probes=1000).collect()}
    some = {(r.id, r.nbr) for r in neighbors.knn_graph(df, "id", "v", 4, "ivf", probes=3).collect()}
    assert whole == exact and len(exact & some) >= 0.95 * len(exact)


def test_search_keeps_its_neighbours_over_many_groups_and_sends_a_block_once_to_each(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "GROUPS", 3)
    sent = []
    plain = neighbors._compared

    def watched(packed, wanted, pairs, *rest):
        sent.append((packed.count(), pairs.count()))
        return plain(packed, wanted, pairs, *rest)

    monkeypatch.setattr(neighbors, "_compared", watched)
    x = np.random.default_rng(5).normal(size=(400, 8))
    check(spark, x, np.arange(400), 7)
    df = vectors(spark, x)
    exact = neighbors.knn_graph(df, "id", "v", 7).orderBy("id", "rk").collect()
    assert neighbors.knn_graph(df, "id", "v", 7, "ivf", probes=1 << 20).orderBy("id", "rk").collect() == exact
    plan = neighbors.knn_graph(df, "id", "v", 7)._jdf.queryExecution().executedPlan().toString()
    assert "grp" in plan and all(pairs > 3 * blocks for blocks, pairs in sent)


def test_probes_are_fitted_to_the_recall_where_no_cell_stands_out(spark):
    x = np.random.default_rng(9).normal(size=(6000, 48))
    df = vectors(spark, x / np.linalg.norm(x, axis=1)[:, None])
    exact = neighbors.knn_graph(df, "id", "v", 5).select("id", "nbr")
    found = neighbors.knn_graph(df, "id", "v", 5, "ivf").select("id", "nbr")
    assert exact.intersect(found).count() >= 0.9 * exact.count()


def test_isolation_ranks_a_row_first_that_no_tree_has_seen(spark):
    rng = np.random.default_rng(11)
    x = np.clip(rng.normal(size=(400, 3)), -2, 2)
    seen = vectors(spark, np.vstack([x, [[2.0, 2.0, 2.0]]])).withColumnRenamed("v", "features")
    far = vectors(spark, [[2.0, 2.0, 2.0], [3.0, 3.0, 3.0], [40.0, 40.0, 40.0]], [500, 501, 502]).withColumnRenamed("v", "features")
    nodes = detectors.isolation_trees(seen, ["id"], 50, 64)
    got = detectors.isolation_scores(seen.unionByName(far), ["id"], nodes, 64).toPandas().set_index("id").isolation_forest
    assert got.idxmin() == 502 and got[502] < got[501] < got[500] - 1e-6
    assert got[500] == got[400]


def test_svm_steps_hold_few_feature_maps_at_once(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(500, 3))
    df = vectors(spark, x).withColumnRenamed("v", "features")
    whole = detectors.one_class_svm(df, ["id"], rounds=5).toPandas().sort_values("id").one_class_svm
    monkeypatch.setattr(detectors, "LIFT_ROWS", 7)
    parts = detectors.one_class_svm(df, ["id"], rounds=5).toPandas().sort_values("id").one_class_svm
    assert np.allclose(whole, parts, atol=1e-4)


def test_neighbours_of_copies_are_searched_once(spark):
    """The hot keys and the join read the written search; the k nearest rows are those of a search by brute force."""
    x = np.repeat(np.random.default_rng(5).integers(0, 4, size=(30, 2)).astype(float), [1, 2, 3, 5, 9] * 6, axis=0)
    edges = neighbors.knn_graph(vectors(spark, x), "id", "v", 4)
    assert "MapInPandas" not in edges._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.id, r.rk): (r.nbr, r.dist) for r in edges.collect()}
    assert len(got) == 4 * len(x)
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i, k + 1][0] for k in range(4)] == want
        assert np.allclose([got[i, k + 1][1] for k in range(4)], d[want])
