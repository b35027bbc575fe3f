"""Mahalanobis distance, isolation forest, one-class SVM and consensus."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import nan_is_missing
from ..functions.rng import key_hash, key_uniform
from ..session import balanced, cut_lineage
from .features import as_matrix, feature_matrix
from .gram import covariance_matrix
from .profile import quantile_threshold
from .ranking import exact_quantiles

COLUMN_FORM_LIMIT = 16


def mahalanobis(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame | None:
    """(key..., mahalanobis) over complete rows of the usable columns; needs more than one of them."""
    fitted = feature_matrix(df, key, cols)
    if fitted is None or len(fitted[1]) < 2:
        return None
    matrix, used = fitted
    d = len(used)
    wide = matrix.select(*[F.col("features")[i].alias(f"f{i}") for i in range(d)])
    inverse = np.linalg.pinv(covariance_matrix(wide, wide.columns, shift=0.0))
    if d <= COLUMN_FORM_LIMIT:
        f = [F.col("features")[i] for i in range(d)]
        terms = [F.lit(float(inverse[i, i])) * f[i] * f[i] for i in range(d)]
        terms += [
            F.lit(float(inverse[i, j] + inverse[j, i])) * f[i] * f[j] for i in range(d) for j in range(i + 1, d)
        ]
        squared = sum(terms[1:], terms[0])
    else:
        shared = df.sparkSession.sparkContext.broadcast(inverse)

        def quadratic(v: pd.Series) -> pd.Series:
            x = as_matrix(v)
            return pd.Series(np.einsum("ij,jk,ik->i", x, shared.value, x, optimize=True))

        squared = F.pandas_udf(quadratic, T.DoubleType())("features")
    return matrix.select(*key, F.sqrt(F.greatest(squared, F.lit(0.0))).alias("mahalanobis"))


@nan_is_missing
def score_threshold(scores: DataFrame, score: str, prob: float = 0.95) -> DataFrame:
    """One row (score, prob, threshold, n_above)."""
    limit = quantile_threshold(scores, score, prob)
    return scores.agg(
        F.lit(score).alias("score"), F.lit(prob).alias("prob"), F.lit(limit).alias("threshold"),
        F.count_if(F.col(score) > F.lit(limit)).alias("n_above"),
    )


# --- isolation forest ------------------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected unsuccessful search length in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (node, feature, split, left, right, depth + average path of the leaf, low, high); low and high hold the node's rows."""
    nodes, todo, fresh = [], [(0, np.arange(len(x)), 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        box = (part.min(axis=0, initial=np.inf), part.max(axis=0, initial=-np.inf))  # a cut at the upper end leaves a node without rows
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(_average_path(len(rows))), *box))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] <= cut
        nodes.append((node, f, cut, fresh, fresh + 1, 0.0, *box))
        todo += [(fresh, rows[left], depth + 1), (fresh + 1, rows[~left], depth + 1)]
        fresh += 2
    return nodes


def isolation_trees(
    matrix: DataFrame, key: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Node table of the forest.

    Key hashes leave each tree about 2 x ``sample`` candidate rows whatever the table size, of
    which it takes ``sample`` without replacement. Large tables give every candidate to one
    tree; on small ones a row may serve several.
    """
    n = matrix.count()
    wanted = 2.0 * trees * sample
    if n > 2 * wanted:
        pool = matrix.where(key_uniform(key, seed) < wanted / n)
        drawn = pool.withColumn("tree", F.pmod(key_hash(key, seed + 1), F.lit(trees)).cast("int"))
    else:
        drawn = matrix.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        if n > 2 * sample:
            drawn = drawn.where(key_uniform([*key, "tree"], seed) < 2.0 * sample / n)
    drawn = drawn.withColumn("_h", key_hash([*key, "tree"], seed + 2))
    place = F.row_number().over(W.partitionBy("tree").orderBy("_h", *key))
    chosen = drawn.withColumn("_p", place).where(F.col("_p") <= sample).select("tree", "_p", "features")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        tree = int(pdf["tree"].iloc[0])
        x = as_matrix(pdf["features"])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "path", "low", "high"])
        out.insert(0, "tree", tree)
        return out

    return chosen.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, split double, left int, right int, path double, low array<double>, high array<double>"
    )


def _path_beyond(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """Expected path of rows outside the sample's range, as if each were in the sample.

    A tree grown with the row draws its cuts from ranges that reach out to it, and a cut between the row and
    the rest leaves it alone; how likely that is at a node follows from the ranges. Otherwise the row goes on as usual.
    """
    feature, split, left, right, path, low, high = tree
    beyond = np.maximum(0.0, np.maximum(x - high[0], low[0] - x))
    total, stays = np.zeros(len(x)), np.ones(len(x))
    at, rows, depth = np.zeros(len(x), dtype=int), np.arange(len(x)), 0
    while len(rows):
        leaf = feature[at[rows]] < 0
        done = rows[leaf]
        total[done] += stays[done] * path[at[done]]
        rows = rows[~leaf]
        if not len(rows):
            break
        node, out = at[rows], beyond[rows]
        width = high[node] - low[node] + out
        drawn = (width > 0).sum(axis=1)
        alone = np.divide(out, width, out=np.zeros_like(out), where=width > 0).sum(axis=1) / drawn
        total[rows] += stays[rows] * alone * (depth + 1)
        stays[rows] *= 1.0 - alone
        at[rows] = np.where(x[rows, feature[node]] <= split[node], left[node], right[node])
        depth += 1
    return total


def isolation_scores(matrix: DataFrame, keep: Sequence[str], nodes: DataFrame, sample_rows: int) -> DataFrame:
    """``keep`` plus isolation_forest = -2^(-mean path / average path); lower is stranger.

    Trees of a few hundred rows seldom hold the strangest of many; a row beyond a tree's sample is scored as if it were in it.
    """
    # bounded by trees x (2 x sample - 1) rows
    table = nodes.toPandas().sort_values(["tree", "node"])
    packed = []
    for _, t in table.groupby("tree"):
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right", "path")) + tuple(as_matrix(t[c]) for c in ("low", "high")))
    shared = matrix.sparkSession.sparkContext.broadcast(packed)
    norm = float(_average_path(np.array(sample_rows)))

    def score(v: pd.Series) -> pd.Series:
        x = as_matrix(v)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in shared.value:
            feature, split, left, right, path, low, high = tree
            at = np.zeros(len(x), dtype=int)
            open_rows = rows[feature[at] >= 0]
            while len(open_rows):
                node = at[open_rows]
                go_left = x[open_rows, feature[node]] <= split[node]
                at[open_rows] = np.where(go_left, left[node], right[node])
                open_rows = open_rows[feature[at[open_rows]] >= 0]
            found = path[at]
            out = np.flatnonzero(((x < low[0]) | (x > high[0])).any(axis=1))
            if len(out):
                found[out] = _path_beyond(x[out], tree)
            total += found
        mean = total / len(shared.value)
        return pd.Series(-np.exp2(-mean / norm) if norm > 0 else np.full(len(x), -0.5))

    return matrix.select(*keep, F.pandas_udf(score, T.DoubleType())("features").alias("isolation_forest"))


def isolation_forest(
    matrix: DataFrame, key: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42
) -> DataFrame:
    """(key..., isolation_forest, isolation_forest_outlier)."""
    matrix = balanced(matrix, key)
    n = matrix.count()
    nodes = isolation_trees(matrix, key, trees, sample, seed)
    scores = cut_lineage(isolation_scores(matrix, key, nodes, min(sample, n)))
    limit = quantile_threshold(scores, "isolation_forest", contamination)
    flag = (F.col("isolation_forest") < F.lit(limit)).cast("int")
    return scores.withColumn("isolation_forest_outlier", flag)


# --- one-class SVM ---------------------------------------------------------------------


SCORE_BINS = 32
LIFT_ROWS = 1024  # rows whose feature maps are held at once


def one_class_svm(
    matrix: DataFrame,
    key: Sequence[str],
    nu: float = 0.1,
    gamma: float | None = None,
    components: int = 512,
    rounds: int = 30,
    seed: int = 42,
) -> DataFrame:
    """(key..., one_class_svm, one_class_svm_outlier) with an approximate RBF kernel.

    Random Fourier features replace the kernel; Frank-Wolfe steps on the dual replace the QP:
    each round averages the feature map over the ``nu`` share of rows with the lowest scores.
    A round is one pass: tasks add the map up per score bin, and the driver, which sees only
    SCORE_BINS x ``components`` sums, takes the lowest bins and the needed part of the last.
    """
    spark = matrix.sparkSession
    matrix = balanced(matrix, key)
    first = matrix.select(F.size("features").alias("d")).first()
    d = first["d"]
    if gamma is None:
        moments = matrix.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (d * moments) if moments else 1.0
    rng = np.random.default_rng(seed)
    omega = spark.sparkContext.broadcast(rng.normal(0.0, math.sqrt(2.0 * gamma), (d, components)))
    phase = rng.uniform(0.0, 2.0 * math.pi, components)

    def lift(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
        z = x.astype(kind) @ omega.value.astype(kind)
        z += phase.astype(kind)
        np.cos(z, out=z)
        z *= kind(math.sqrt(2.0 / components))
        return z

    def bin_sums(w: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row counts and feature-map sums of each score bin."""

        # single precision here: the steps only lead to weights, which then score the rows in double
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(edges) + 1, components)), np.zeros(len(edges) + 1)
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for lo in range(0, len(flat), LIFT_ROWS):
                    z = lift(flat[lo : lo + LIFT_ROWS], np.float32)
                    at = np.searchsorted(edges, z @ w.astype(np.float32))
                    n += np.bincount(at, minlength=len(n))
                    inside = np.zeros((len(n), len(z)), np.float32)
                    inside[at, np.arange(len(z))] = 1.0
                    total += inside @ z
            for k in np.flatnonzero(n):
                rows = [np.full(components, k, np.int32), np.arange(components, dtype=np.int32), total[k], np.full(components, n[k])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["bin", "j", "s", "n"])

        parts = matrix.select("features").mapInArrow(sums, "bin int, j int, s double, n double")
        n, total = np.zeros(len(edges) + 1), np.zeros((len(edges) + 1, components))
        for r in parts.groupBy("bin", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            total[r["bin"], r["j"]], n[r["bin"]] = r["s"], r["n"]
        return n, total

    n, total = bin_sums(np.zeros(components), np.zeros(0))
    rows, w = n[0], total[0] / n[0]
    low, high = -math.sqrt(2.0) * np.linalg.norm(w), math.sqrt(2.0) * np.linalg.norm(w)
    for _ in range(rounds):
        edges = np.linspace(low, high, SCORE_BINS + 1)
        n, total = bin_sums(w, edges)
        upto = np.cumsum(n)
        last = int(np.argmax(upto >= nu * rows))
        taken = upto[last - 1] if last else 0.0
        share = (nu * rows - taken) / n[last]
        v = (total[:last].sum(axis=0) + share * total[last]) / (nu * rows)
        gap = w - v
        size = float(gap @ gap)
        step = min(1.0, float(w @ gap) / size) if size > 0 else 0.0
        if step <= 1e-6:
            break
        w = w - step * gap
        # the next cut is near this one: spend the bins below it and a little above
        cut = edges[min(last, SCORE_BINS)]
        low, high = cut - 0.5 * np.linalg.norm(w), cut + 0.25 * np.linalg.norm(w)

    def score(v: pd.Series) -> pd.Series:
        return pd.Series(lift(as_matrix(v)) @ w)

    scores = cut_lineage(matrix.select(*key, F.pandas_udf(score, T.DoubleType())("features").alias("one_class_svm")))
    limit = quantile_threshold(scores, "one_class_svm", nu)
    return scores.withColumn("one_class_svm_outlier", (F.col("one_class_svm") < F.lit(limit)).cast("int"))


# --- consensus -------------------------------------------------------------------------


def consensus_outliers(scores: DataFrame, keep: Sequence[str], minimum: int = 2) -> DataFrame:
    """``keep`` plus votes and consensus_outlier over every ``*_outlier`` column."""
    flags = [c for c in scores.columns if c.endswith("_outlier")]
    votes = sum((F.coalesce(F.col(c), F.lit(0)) for c in flags), F.lit(0))
    return scores.select(*keep, votes.alias("votes"), (votes >= minimum).cast("int").alias("consensus_outlier"))


def consensus_counts(consensus: DataFrame) -> DataFrame:
    label = F.when(F.col("consensus_outlier") == 1, "Outlier").otherwise("Normal")
    return consensus.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@nan_is_missing
def quantile_flags(scores: DataFrame, score: str, prob: float, above: bool = True) -> DataFrame:
    """Add ``<score>_outlier`` by an exact quantile of the score."""
    row = exact_quantiles(scores, [score], [prob]).first()
    limit = row["quantile"] if row else None
    test = F.col(score) > F.lit(limit) if above else F.col(score) < F.lit(limit)
    return scores.withColumn(f"{score}_outlier", test.cast("int"))
