"""Pairwise-complete sums of squares and products for all column pairs in one pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import normalize_missing

_PARTIALS = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _shifts(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """A value near the mean of each column; the constant itself where a column has one value."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs.append(F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.avg(v)).alias(c))
    row = df.agg(*aggs).first()
    return np.array([0.0 if row[k] is None else row[k] for k in range(len(cols))], dtype=float)


def pair_sums(df: DataFrame, cols: Sequence[str], shift: float | None = None) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i <= j over rows where both are present.

    Values are shifted towards 0 first, by ``shift`` where the caller knows the columns' mean
    and by one pass over the data otherwise. A task keeps d x d accumulators whatever its row
    count and emits them once.
    """
    d = len(cols)
    df = normalize_missing(df)
    shift = _shifts(df, cols) if shift is None else np.full(d, float(shift))
    upper_i, upper_j = np.triu_indices(d)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, xy = (np.zeros((d, d)) for _ in range(4))
        seen = False
        for pdf in batches:
            seen = True
            x = pdf.to_numpy(dtype=float)
            mask = ~np.isnan(x)
            x = np.where(mask, x - shift, 0.0)
            m = mask.astype(float)
            n += m.T @ m
            s += x.T @ m
            q += (x * x).T @ m
            xy += x.T @ x
        if seen:
            i, j = upper_i, upper_j
            yield pd.DataFrame(
                {
                    "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j],
                    "sx": s[i, j], "sy": s[j, i], "sxx": q[i, j], "syy": q[j, i], "sxy": xy[i, j],
                }
            )

    wide = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    parts = wide.mapInPandas(partials, _PARTIALS)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def bounded(c: Column, low: float = -1.0) -> Column:
    """Within [low, 1]; null stays null, which least and greatest alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(1.0), c)))


def covariance_expr() -> Column:
    return F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1)


def correlation_expr() -> Column:
    sx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    sy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # a column constant on the shared rows leaves only rounding noise
    flat = (sx <= F.col("sxx") * 1e-13) | (sy <= F.col("syy") * 1e-13)
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(F.greatest(sx * sy, F.lit(0.0))))
    return F.when((F.col("n") > 1) & ~flat, bounded(r))


def names(cols: Sequence[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(index) + 1)


def pearson_pairs(df: DataFrame, cols: Sequence[str], shift: float | None = None) -> DataFrame:
    """(x, y, r, covariance, n) for every pair including x = y, x before y in ``cols``."""
    return pair_sums(df, cols, shift).select(
        names(cols, "i").alias("x"),
        names(cols, "j").alias("y"),
        correlation_expr().alias("r"),
        covariance_expr().alias("covariance"),
        F.col("n").cast("bigint").alias("n"),
    )


def covariance_matrix(df: DataFrame, cols: Sequence[str], shift: float | None = None) -> np.ndarray:
    """Sample covariance as a d x d array on the driver; d is the number of columns."""
    sums = pair_sums(df, cols, shift)
    out = np.full((len(cols), len(cols)), np.nan)
    for r in sums.select("i", "j", covariance_expr().alias("c")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = np.nan if r["c"] is None else r["c"]
    return out
