import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.rng import normals
from tabloom.operators import encode, features, flow
from tabloom.plans import synthesize


def rows(spark):
    data = [
        (1, 1.0, 5.0, "a", "u"), (2, 2.0, 5.0, "b", None), (3, 4.0, 5.0, "nan", "v"), (4, None, None, None, None),
    ]
    return spark.createDataFrame(data, "k int, n double, same double, X string, X_Y string")


def test_round_trip_and_prefix_clash(spark):
    df = rows(spark)
    enc = encode.TabularEncoder(["n", "same"], ["X", "X_Y"], ["n"]).fit(df)
    assert enc.n_rows_filtered == 1 and enc.n_features == 2 + 4 + 3
    t = enc.transform(df, ["k"])
    assert t.count() == 3
    for r in t.collect():
        assert set(np.round(r.features[2:], 12)) <= {-1.0, 1.0} and r.features[1] == -1.0
    back = {r.k: r for r in enc.inverse_transform(t, ["k"]).collect()}
    assert (back[1].n, back[1].same, back[1].X, back[1].X_Y) == (1, 5.0, "a", "u")
    assert back[2].X_Y is None and back[3].X == "nan"


def test_unknown_level_and_unfitted(spark):
    enc = encode.TabularEncoder([], ["X"], max_missing_ratio=None)
    with pytest.raises(RuntimeError):
        enc.n_features
    enc.fit(rows(spark).where("k <= 2"))
    other = spark.createDataFrame([(9, "zzz"), (10, None)], "k int, X string")
    got = {r.k: r.features for r in enc.transform(other, ["k"]).collect()}
    assert got[9] == [-1.0, -1.0, -1.0] and got[10] == [-1.0, -1.0, 1.0]


def test_text_column_is_not_numeric(spark):
    with pytest.raises(ValueError):
        encode.TabularEncoder(["X"], []).fit(rows(spark))


def test_one_hot_binary_and_caps(spark):
    out = features.one_hot(rows(spark).where("k <= 3"), ["X", "X_Y"], ["k"])
    assert out.columns == ["k", "X_a", "X_b", "X_missing", "X_Y_missing", "X_Y_u", "X_Y_v"]
    two = spark.createDataFrame([(1, "p"), (2, "q")], "k int, c string")
    assert features.one_hot(two, ["c"], ["k"]).columns == ["k", "c_q"]
    wide = spark.range(60).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        features.one_hot(wide, ["c"], max_levels=50)


def test_noise_is_a_standard_normal_of_the_key():
    base = np.arange(20000, dtype=np.int64) * 7919 - 10**15
    z = normals(base, 3, 2)
    assert np.allclose(z.mean(0), 0, atol=0.03) and np.allclose(z.std(0), 1, atol=0.03)
    assert abs(np.corrcoef(z.T)[0, 1]) < 0.03 and abs(np.corrcoef(z[:, 0], normals(base, 4, 2)[:, 0])[0, 1]) < 0.03
    assert np.array_equal(z[100:200], normals(base[100:200], 3, 2))


def mixture(spark, n=600):
    rng = np.random.default_rng(1)
    lab = (rng.random(n) < 0.3).astype(int)
    x = np.where(lab == 1, rng.normal(0.6, 0.1, n), rng.normal(-0.5, 0.15, n))
    pdf = pd.DataFrame({"k": np.arange(n), "features": [[v] for v in x], "lab": lab})
    return spark.createDataFrame(pdf, "k long, features array<double>, lab int"), x


def test_training_pairs_lie_on_the_path(spark):
    df, x = mixture(spark, 50)
    p = flow.FlowParams(nt=4, n_noise=2)
    pairs = flow.training_pairs(df, ["k"], p).collect()
    assert len(pairs) == 50 * 4 * 2
    for r in pairs:
        t = (r.level + 1) / 4
        assert r.x_t[0] + (1 - t) * r.y_t[0] == pytest.approx(x[r.k])


def test_flow_learns_the_marginal_and_ignores_partitioning(spark):
    df, x = mixture(spark)
    p = flow.FlowParams(nt=4, n_noise=4, trees=4, depth=3, learning_rate=0.5, bins=32)
    model = flow.FlowSynthesizer(p).fit(df, ["k"])
    again = flow.FlowSynthesizer(p).fit(df.repartition(3), ["k"])
    a = model.sample(spark, 1500).toPandas().sort_values("id")
    b = again.sample(spark, 1500, partitions=5).toPandas().sort_values("id")
    va, vb = np.vstack(a.features)[:, 0], np.vstack(b.features)[:, 0]
    assert np.allclose(va, vb, atol=1e-4)
    assert abs(va.mean() - x.mean()) < 0.12 and abs((va > 0.2).mean() - (x > 0.2).mean()) < 0.1
    assert np.abs(va).max() <= 1.0
    reverse = np.vstack(model.sample(spark, 1500, direction="reverse").toPandas().features)[:, 0]
    assert not np.allclose(np.sort(reverse), np.sort(va), atol=0.05)


def test_label_conditional(spark):
    df, _ = mixture(spark)
    p = flow.FlowParams(nt=3, n_noise=2, trees=3, depth=2, learning_rate=0.6, bins=32)
    model = flow.FlowSynthesizer(p).fit(df, ["k"], "lab")
    out = model.sample(spark, 1000).toPandas()
    means = out.assign(v=np.vstack(out.features)[:, 0]).groupby("label").v.mean()
    assert abs((out.label == 1).mean() - 0.3) < 0.06 and means[1] > 0.3 > -0.2 > means[0]
    assert model.sample(spark, 0).count() == 0


def test_incomplete_rows_are_dropped_and_none_is_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), 0.0])], "k int, features array<double>")
    assert flow.complete_rows(df).count() == 0
    with pytest.raises(ValueError):
        flow.FlowSynthesizer(flow.FlowParams(nt=2, n_noise=1, trees=1, depth=1)).fit(df, ["k"])
    with pytest.raises(RuntimeError):
        flow.FlowSynthesizer().sample(spark, 3)


def test_synthesize_end_to_end(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(
        {"k": np.arange(400), "v": rng.normal(10, 2, 400), "n": rng.integers(0, 4, 400), "c": rng.choice(["x", "y"], 400)}
    )
    p = flow.FlowParams(nt=3, n_noise=2, trees=2, depth=2, learning_rate=0.6, bins=32)
    out = synthesize.synthesize(spark.createDataFrame(pdf), ["k"], ["c"], ["n"], (), 200, p)
    got = out.synthetic.toPandas()
    assert len(got) == 200 and set(got.c) <= {"x", "y", None} and set(got.n) <= {0, 1, 2, 3}
    assert pdf.v.min() <= got.v.min() and got.v.max() <= pdf.v.max()
    assert {"numeric", "levels_c"} <= set(out.comparison)


def boosted_by_hand(x, z, p):
    """The same trees without Spark: predictions of every level's field for the training points, by tree."""
    out = {}
    for level in range(p.nt):
        t = p.level(level)
        x_t, y = (1 - t) * z + t * x, (x - z).astype(np.float32)
        binned = np.searchsorted(flow.bin_edges(t, p.bins), x_t, side="left")
        left, made = y.copy(), np.zeros_like(y)
        for _ in range(p.trees):
            leaf = {0: np.arange(len(x))}
            value = {0: p.learning_rate * left.sum(0) / len(x)}
            for _ in range(p.depth):
                nxt = {}
                for node, rows in leaf.items():
                    best = (0.0, None)
                    for f in range(x.shape[1]):
                        for c in range(p.bins - 1):
                            low = rows[binned[rows, f] <= c]
                            high = rows[binned[rows, f] > c]
                            if len(low) and len(high):
                                sums = [left[r].astype(float).sum(0) for r in (low, high, rows)]
                                gain = sum((s**2).sum() / len(r) for s, r in zip(sums[:2], (low, high))) - (sums[2] ** 2).sum() / len(rows)
                                if gain > best[0] + 1e-9:
                                    best = (gain, (low, high, sums))
                    if best[1] is None:
                        nxt[node] = rows
                        continue
                    for k, side in enumerate((2 * node + 1, 2 * node + 2)):
                        nxt[side] = best[1][k]
                        value[side] = p.learning_rate * best[1][2][k] / len(best[1][k])
                leaf = nxt
            step = np.zeros_like(y)
            for node, rows in leaf.items():
                step[rows] = value[node]
            made, left = made + step, left - step
        out[level] = made
    return out


def test_trees_equal_plain_boosting(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (120, 2)).round(3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k long, features array<double>")
    p = flow.FlowParams(nt=2, n_noise=1, trees=3, depth=3, learning_rate=0.5, bins=16)
    model = flow.FlowSynthesizer(p).fit(df.repartition(3), ["k"])
    base = df.select(flow.key_hash(["k"], p.seed).alias("b")).toPandas()["b"].to_numpy()
    z = normals(base, 0, 2)
    want = boosted_by_hand(x, z, p)
    rows = {r["level"]: r for r in model.forest.collect()}
    for level in range(2):
        t = p.level(level)
        binned = np.searchsorted(flow.bin_edges(t, p.bins), (1 - t) * z + t * x, side="left")
        got = np.zeros_like(x)
        r = rows[level]
        assert len(r["feature"]) == 3
        for f, c, v in zip(r["feature"], r["cut"], r["value"]):
            f = np.frombuffer(f, np.int16)
            got += np.frombuffer(v, np.float32).reshape(len(f), 2)[flow.walk(f, np.frombuffer(c, np.uint8), binned, p.depth)]
        assert np.allclose(got, want[level], atol=1e-4)


def test_late_trees_take_no_longer_than_early_ones(spark):
    df, _ = mixture(spark, 300)
    p = flow.FlowParams(nt=2, n_noise=2, trees=100, depth=1, learning_rate=0.1, bins=16)
    model = flow.FlowSynthesizer(p).fit(df, ["k"])
    # the quickest of the late ones, as other work on the machine comes and goes
    early, late = np.median(model.tree_seconds[1:21]), min(model.tree_seconds[-30:])
    assert len(model.tree_seconds) == 100 and late <= 1.2 * early
    assert all(len(r["feature"]) == 100 for r in model.forest.collect())


@pytest.mark.parametrize("direct", [flow.DIRECT_BYTES, 0])
def test_a_round_is_one_job_for_each_level_of_depth(spark, monkeypatch, direct):
    """Whoever adds the histograms up; a checkpoint is one more job."""
    monkeypatch.setattr(flow, "DIRECT_BYTES", direct)
    monkeypatch.setattr(flow, "CHECKPOINT_ROUNDS", 3)
    df, x = mixture(spark, 300)
    sc, jobs, forests = spark.sparkContext, {}, {}
    for trees in (2, 6):
        sc.setJobGroup(f"{direct}_{trees}", "")
        p = flow.FlowParams(nt=2, n_noise=2, trees=trees, depth=3, learning_rate=0.5, bins=16)
        forests[trees] = flow.FlowSynthesizer(p).fit(df.repartition(3), ["k"]).forest.orderBy("level").collect()
        jobs[trees] = len(sc.statusTracker().getJobIdsForGroup(f"{direct}_{trees}"))
    sc._jsc.clearJobGroup()
    assert jobs[6] - jobs[2] <= 4 * 3 + 1
    assert all(a["feature"] == b["feature"][:2] and a["cut"] == b["cut"][:2] for a, b in zip(forests[2], forests[6]))


def test_two_thousand_labels_in_several_groups(spark, monkeypatch):
    """Every label has its own trees; labels are drawn by their shares."""
    monkeypatch.setattr(flow, "GROUP_CUTS", 2400)
    df = spark.range(6000).select("id", F.array((F.col("id") % 2000 / 1000.0 - 1.0)).alias("features"), (F.col("id") % 2000).alias("lab"))
    p = flow.FlowParams(nt=2, n_noise=1, trees=1, depth=1, learning_rate=1.0, bins=8)
    model = flow.FlowSynthesizer(p).fit(df, ["id"], "lab")
    assert model.forest.count() == 2 * 2000 and model.label_table.agg(F.countDistinct("lab"), F.max("lab")).first()[:] == (2000, 1999)
    made = model.sample(spark, 20_000)
    assert made.count() == 20_000 and made.select("id").distinct().count() == 20_000
    drawn = made.groupBy("label").count().toPandas()["count"]
    assert len(drawn) > 1990 and drawn.max() < 35
    corr = made.select(F.corr("label", F.col("features")[0])).first()[0]
    assert corr > 0.5


def test_labels_fill_the_unit_interval(spark):
    counts = [(f"l{i}", i % 7 + 1) for i in range(50)] + [("hot", 400)]
    dist = spark.createDataFrame(counts, "label string, n long").withColumn("prob", F.col("n") / sum(c[1] for c in counts))
    table = flow.numbered_labels(dist)
    got = sorted((r["low"], r["high"], r["lab"]) for r in table.collect())
    assert got[0][0] == pytest.approx(0) and got[-1][1] == pytest.approx(1) and sorted(g[2] for g in got) == list(range(51))
    assert all(a[1] == pytest.approx(b[0], abs=1e-12) for a, b in zip(got, got[1:]))
    ids = flow.drawn_labels(spark.range(30_000), table, 5)
    assert ids.count() == 30_000
    share = ids.join(table, "lab").where("label = 'hot'").count() / 30_000
    assert abs(share - 400 / sum(c[1] for c in counts)) < 0.02


def test_only_the_smaller_child_is_added_up(spark, monkeypatch):
    """Whether the driver, a shuffle or the tasks find the cuts: the same trees."""
    sums, seen = flow.FlowSynthesizer._sums, []

    def spied(self, state, trees, depth, slots, pending):
        seen.append((depth, pending is not None, [int((s >= 0).sum()) for s in slots]))
        return sums(self, state, trees, depth, slots, pending)

    monkeypatch.setattr(flow.FlowSynthesizer, "_sums", spied)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.uniform(-1, 1, (150, 2)))], "k long, features array<double>")
    p = flow.FlowParams(nt=2, n_noise=2, trees=3, depth=3, learning_rate=0.5, bins=16)
    forests = []
    for held, direct in ((flow.HELD_BYTES, flow.DIRECT_BYTES), (flow.HELD_BYTES, 0), (0, 0)):
        monkeypatch.setattr(flow, "HELD_BYTES", held)
        monkeypatch.setattr(flow, "DIRECT_BYTES", direct)
        forests.append(flow.FlowSynthesizer(p).fit(df.repartition(3), ["k"]).forest.orderBy("level").collect())
    for other in forests[1:]:
        for a, b in zip(forests[0], other):
            assert a["feature"] == b["feature"] and a["cut"] == b["cut"]
            assert all(np.allclose(np.frombuffer(v, np.float32), np.frombuffer(w, np.float32), atol=1e-5) for v, w in zip(a["value"], b["value"]))
    # all residuals once, then of each split one child; later roots take counts alone
    assert all(max(slots) <= 2 ** max(depth - 1, 0) for depth, residuals, slots in seen if residuals)
    assert sum(depth == 0 and residuals for depth, residuals, _ in seen) == 2 and sum(not residuals for _, residuals, _ in seen) == 4


def test_draws_of_a_row_are_one_row_where_noise_ends(spark):
    x = np.array([[0.5, -1.0], [0.5, -1.0], [-0.25, 1.0], [0.9, 1.0]])
    train = spark.createDataFrame([(r.tolist(), 0, i) for i, r in enumerate(x)], "features array<double>, lab int, base long").coalesce(1)
    p = flow.FlowParams(nt=2, n_noise=5, bins=16)
    model = flow.FlowSynthesizer(p, dims=2)
    state, path = model._first_state(train, len(x))
    rows = state.collect()
    flow.drop_path(spark, path)
    first = [r for r in rows if r["level"] == 0]
    assert sum(r["n"] for r in first) == 20 and not any(r["weight"] for r in first)
    weight = np.concatenate([np.frombuffer(r["weight"]) for r in rows if r["level"] == 1])
    assert weight.sum() == 20 and len(weight) <= 4
    y = sum((x - normals(np.arange(4), rep, 2)).sum(axis=0) for rep in range(5))
    got = sum((np.frombuffer(r["residual"], np.float32).reshape(2, -1) * np.frombuffer(r["weight"])).sum(axis=1) for r in rows if r["level"] == 1)
    assert np.allclose(got, y, atol=1e-4)
