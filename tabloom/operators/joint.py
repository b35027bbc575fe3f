"""Joint distribution of column pairs: mutual information and combined statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import nan_is_missing
from ..functions.rng import key_uniform
from ..session import cut_lineage
from .associate import _pair_names, _with_margins, contingency, corr_matrix, count_entropy
from .gram import pearson_pairs
from .neighbors import knn_graph
from .profile import bin_columns, fitted_stats, quantile_bins
from .ranking import bucket_edges, with_buckets

MIN_ROWS = 100  # fixed value: pairs need more shared rows than this


@nan_is_missing
def mutual_information(
    df: DataFrame,
    cols: Sequence[str],
    bins: int = 20,
    method: str = "hist",
    key: Sequence[str] | None = None,
    min_rows: int = MIN_ROWS,
    k: int = 3,
    seed: int = 42,
    below: float | None = None,
) -> DataFrame:
    """(x, y, mi, n) in nats for every pair x before y; ``below`` when a pair has too few shared rows.

    Null says "not known"; 0.0 as ``below`` is the number some reports show there.

    "hist" bins each column into equal widths, "quantile" into equal counts; both are exact for those bins, all
    pairs in one job. "ksg" is the nearest-neighbour estimator for continuous data, one search per pair.
    The estimators give different numbers.
    """
    if method == "ksg":
        if not key:
            raise ValueError("ksg needs the row key")
        return _ksg_matrix(df, cols, key, min_rows, k, seed)
    if method not in ("hist", "quantile"):
        raise ValueError(method)
    binned = quantile_bins(df, cols, bins) if method == "quantile" else df.select(*bin_columns(df, cols, bins))
    m = _with_margins(contingency(binned, cols, null_level=None))
    o, n = F.col("o"), F.col("n")
    sums = m.groupBy("i", "j").agg(
        F.sum("o").alias("n"), F.sum(o * (F.log("o") - F.log("r") - F.log("c"))).alias("s")
    )
    mi = F.greatest(F.lit(0.0), F.log(n) + F.col("s") / n)
    return _pair_names(sums.withColumn("mi", mi), cols).select(
        "x", "y", F.when(n > min_rows, F.col("mi")).otherwise(F.lit(below).cast("double")).alias("mi"), n.cast("bigint").alias("n")
    )


@nan_is_missing
def self_information(
    df: DataFrame, cols: Sequence[str], diagonal: str = "entropy", bins: int = 20, min_rows: int = MIN_ROWS
) -> DataFrame:
    """(x, y, mi) diagonal: entropy of the binned column, or its variance where that is usable."""
    if diagonal == "variance":
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("x"), F.lit(c).alias("y"),
                    F.when((F.count(c) > min_rows) & (F.var_samp(c) > 0), F.var_samp(c)).otherwise(1.0).alias("mi"),
                )
                for c in cols
            ]
        )
        return df.agg(cells.alias("s")).select(F.inline("s"))
    binned = df.select(*bin_columns(df, cols, bins))
    values = F.array(*[F.struct(F.lit(c).alias("x"), F.col(c).alias("b")) for c in cols])
    counts = binned.select(F.inline(values)).where("b IS NOT NULL").groupBy("x", "b").agg(F.count(F.lit(1)).alias("o"))
    return count_entropy(counts, "x", "o", "mi").select("x", F.col("x").alias("y"), "mi")


def mutual_information_matrix(
    df: DataFrame, cols: Sequence[str], diagonal: str = "entropy", bins: int = 20, min_rows: int = MIN_ROWS
) -> DataFrame:
    """(x, y, mi) for every ordered pair and the diagonal."""
    upper = mutual_information(df, cols, bins, min_rows=min_rows).select("x", "y", "mi")
    lower = upper.select(F.col("y").alias("x"), F.col("x").alias("y"), "mi")
    return upper.unionByName(lower).unionByName(self_information(df, cols, diagonal, bins, min_rows))


@nan_is_missing
def joint_stats(
    df: DataFrame, cols: Sequence[str], key: Sequence[str], bins: int = 20, min_rows: int = MIN_ROWS
) -> DataFrame:
    """One row per pair: pearson, spearman, covariance, mutual information and n; null below ``min_rows`` shared rows."""
    linear = pearson_pairs(df, cols).where(F.col("x") != F.col("y"))
    rank = corr_matrix(df, cols, "spearman", key).where("x != y")
    mi = mutual_information(df, cols, bins, min_rows=min_rows)
    enough = F.col("n") > min_rows
    return (
        linear.join(rank.select("x", "y", F.col("r").alias("spearman")), ["x", "y"], "left")
        .join(mi.select("x", "y", "mi"), ["x", "y"], "left")
        .select(
            F.col("x").alias("column1"), F.col("y").alias("column2"),
            F.when(enough, F.col("r")).alias("pearson_correlation"), F.when(enough, F.col("spearman")).alias("spearman_correlation"),
            F.when(enough, F.col("covariance")).alias("covariance"), F.col("mi").alias("mutual_information"), F.col("n").alias("n_samples"),
        )
    )


def top_pairs(pairs: DataFrame, value: str = "r", k: int = 4) -> DataFrame:
    """The ``k`` unordered pairs with the largest absolute statistic."""
    return (
        pairs.where((F.col("x") != F.col("y")) & (F.abs(F.col(value)) > 0))
        .orderBy(F.desc(F.abs(F.col(value))), "x", "y")
        .limit(k)
    )


def pairs_to_show(pairs: DataFrame, cols: Sequence[str], value: str = "r", k: int = 4) -> list[tuple[str, str]]:
    """Top pairs, or the first column against the next ones when nothing correlates."""
    found = [(r["x"], r["y"]) for r in top_pairs(pairs, value, k).collect()]
    return found or [(cols[0], c) for c in cols[1 : k + 1]]


# --- nearest-neighbour estimator -------------------------------------------------------


def digamma_int(n: np.ndarray) -> np.ndarray:
    """Digamma at positive integers: recurrence up to 6, then the asymptotic series."""
    x = np.asarray(n, dtype=float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        out[small] -= 1.0 / x[small]
        x[small] += 1.0
    inv = 1.0 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))


def _count_within(points: DataFrame, col: str) -> DataFrame:
    """(id, hits): values of ``col`` strictly nearer than the row's ``radius``, itself included.

    Values and both ends of every interval are merged along the axis inside value buckets;
    running counts plus bucket offsets give each end's rank.
    """
    edges = bucket_edges(points, [col])
    # the k-th neighbour lies exactly on the interval's end in one of the columns; stay clear of
    # the rounding of value +- radius so that it is never counted
    r = F.col("radius") * F.lit(1.0 - 1e-12) - F.lit(4e-16) * (F.abs(F.col(col)) + F.col("radius"))
    marks = points.select(
        "id",
        F.inline(
            F.array(
                F.struct((F.col(col) - r).alias("at"), F.lit(0).alias("kind")),
                F.struct(F.col(col).alias("at"), F.lit(1).alias("kind")),
                F.struct((F.col(col) + r).alias("at"), F.lit(2).alias("kind")),
            )
        ),
    )
    placed = with_buckets(marks, {"at": edges[col]}).withColumnRenamed("_b_at", "bucket")
    # interval ends are open, so values equal to the upper end must come after it
    rank_in_tie = F.when(F.col("kind") == 2, 0).when(F.col("kind") == 1, 1).otherwise(2)
    one = (F.col("kind") == 1).cast("bigint")
    order = W.partitionBy("bucket").orderBy("at", rank_in_tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = placed.groupBy("bucket").agg(F.sum(one).alias("_n"))
    upto = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    counted = placed.withColumn("_run", F.sum(one).over(order)).where("kind != 1").join(offsets, "bucket")
    upto_here = F.col("_run") + F.col("_offset")
    return counted.groupBy("id").agg(
        (F.sum(F.when(F.col("kind") == 2, upto_here)) - F.sum(F.when(F.col("kind") == 0, upto_here))).alias("hits")
    )


def _ksg_pair(df: DataFrame, x: str, y: str, key: Sequence[str], min_rows: int, k: int, seed: int) -> tuple[float, int]:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    stats = fitted_stats(both, ["x", "y"])
    n = stats["x"]["n"]
    if n <= min_rows:
        return 0.0, n
    # unit variance plus keyed noise far below the data's resolution, so no two values tie
    scaled = []
    for i, c in enumerate(("x", "y")):
        v = F.col(c) / F.lit(stats[c]["std_pop"] or 1.0)
        size = both.agg(F.avg(F.abs(v))).first()[0]
        u1 = key_uniform(key, seed + 2 * i)
        u2 = key_uniform(key, seed + 2 * i + 1)
        normal = F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(2.0 * np.pi) * u2)
        scaled.append((v + F.lit(1e-10 * max(1.0, size)) * normal).alias(c))
    ident = F.xxhash64(*key) if len(key) > 1 else F.col(key[0])
    points = cut_lineage(both.select(ident.alias("id"), *scaled))
    edges = knn_graph(points.withColumn("v", F.array("x", "y")), "id", "v", k, metric="chebyshev", seed=seed)
    radius = edges.groupBy("id").agg(F.max("dist").alias("radius"))
    balls = cut_lineage(points.join(radius, "id"))
    hits = _count_within(balls, "x").withColumnRenamed("hits", "nx").join(
        _count_within(balls, "y").withColumnRenamed("hits", "ny"), "id"
    )

    def psi(v: pd.Series) -> pd.Series:
        return pd.Series(digamma_int(np.maximum(v.to_numpy(), 1)))

    psi_udf = F.pandas_udf(psi, T.DoubleType())
    mean = hits.agg(F.avg(psi_udf("nx") + psi_udf("ny"))).first()[0]
    ends = digamma_int(np.array([n, k]))
    return max(0.0, float(ends.sum() - mean)), n


def _ksg_matrix(df: DataFrame, cols: Sequence[str], key: Sequence[str], min_rows: int, k: int, seed: int) -> DataFrame:
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            rows.append((a, b, *_ksg_pair(df, a, b, key, min_rows, k, seed)))
    return df.sparkSession.createDataFrame(rows, "x string, y string, mi double, n bigint")
