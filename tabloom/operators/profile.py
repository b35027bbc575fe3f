"""Univariate profiles: z-scores, fences, describe, histograms, box and density data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.missing import nan_is_missing, normalize_missing
from .aggregates import column_stats
from .ranking import exact_quantiles, quantiles_wide, with_buckets


@nan_is_missing
def fitted_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Column statistics as plain numbers, one record per column."""
    return {r["feature"]: r.asDict() for r in column_stats(df, cols).collect()}


def z_scores(df: DataFrame, cols: Sequence[str], keep: Sequence[str], flag: float | None = None) -> DataFrame:
    """``<c>_zscore`` per column against the sample std; columns without spread are left out.

    With ``flag`` a boolean ``<c>_extreme`` marks |z| above it.
    """
    df = normalize_missing(df)
    stats = fitted_stats(df, cols)
    out: list[Column] = []
    for c in cols:
        std = stats[c]["std"]
        if std is None or std == 0 or stats[c]["min"] == stats[c]["max"]:
            continue
        z = (quoted(c) - F.lit(stats[c]["mean"])) / F.lit(std)
        out.append(z.alias(f"{c}_zscore"))
        if flag is not None:
            out.append((F.abs(z) > flag).alias(f"{c}_extreme"))
    return df.select(*keep, *out)


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Population-std scaling; a column without spread becomes 0."""
    df = normalize_missing(df)
    stats = fitted_stats(df, cols)
    exprs = []
    for c in cols:
        s = stats[c]["std_pop"] or 1.0
        exprs.append(((quoted(c) - F.lit(stats[c]["mean"])) / F.lit(s)).alias(c))
    return df.select(*keep, *exprs)


@nan_is_missing
def iqr_fences(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, q1, q3, iqr, lower_bound, upper_bound)."""
    iqr = F.col("q3") - F.col("q1")
    return quantiles_wide(df, cols, {"q1": 0.25, "q3": 0.75}).select(
        "feature", "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - 1.5 * iqr).alias("lower_bound"), (F.col("q3") + 1.5 * iqr).alias("upper_bound"),
    )


@nan_is_missing
def iqr_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fences plus the number of values outside them."""
    fences = {r["feature"]: r for r in iqr_fences(df, cols).collect()}  # one row per column
    names = ("q1", "q3", "iqr", "lower_bound", "upper_bound")

    def cell(c: str) -> Column:
        value, f = quoted(c), fences.get(c)
        outside = (value < f["lower_bound"]) | (value > f["upper_bound"]) if f else F.lit(False)
        return F.struct(
            F.lit(c).alias("feature"),
            *[F.lit(f[n] if f else None).cast("double").alias(n) for n in names],
            F.count_if(outside).alias("outlier_count"),
            F.count(value).alias("n"),
        )

    return df.agg(F.array(*[cell(c) for c in cols]).alias("s")).select(F.inline("s")).where("n > 0")


@nan_is_missing
def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers (last values inside the fences) and outlier count."""
    found = {r["feature"]: r for r in quantiles_wide(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()}

    def cell(c: str) -> Column:
        value, q = quoted(c).cast("double"), found[c]
        reach = 1.5 * (q["q3"] - q["q1"])
        inside = (value >= q["q1"] - reach) & (value <= q["q3"] + reach)
        return F.struct(
            F.lit(c).alias("feature"),
            *[F.lit(q[n]).cast("double").alias(n) for n in ("q1", "median", "q3")],
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outlier_count"),
        )

    cells = [cell(c) for c in cols if c in found]
    if not cells:
        kinds = "feature string, q1 double, median double, q3 double, whisker_low double, whisker_high double, outlier_count long"
        return df.sparkSession.createDataFrame([], kinds)
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


@nan_is_missing
def describe_numeric(df: DataFrame, cols: Sequence[str], digits: int | None = 2) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    stats = column_stats(df, cols).select("feature", "n", "mean", "std", "min", "max")
    quart = quantiles_wide(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    out = stats.join(F.broadcast(quart), "feature", "left")
    values = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    shown = [F.round(c, digits).alias(c) if digits is not None else F.col(c) for c in values]
    return out.select("feature", F.col("n").alias("count"), *shown)


def quantile_threshold(scores: DataFrame, score: str, prob: float) -> float | None:
    """One exact quantile of a score column as a number."""
    row = exact_quantiles(scores, [score], [prob]).first()
    return None if row is None else row["quantile"]


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin, the maximum in the last one; null has no bin."""
    if high <= low:
        return F.when(value.isNotNull(), F.lit(0).cast("bigint"))
    step = (value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))
    return F.when(value.isNotNull(), F.least(F.lit(bins - 1), F.floor(step)).cast("bigint"))


@nan_is_missing
def value_ranges(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    return {
        c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(cols) if row[f"lo_{i}"] is not None
    }


def bin_columns(df: DataFrame, cols: Sequence[str], bins: int) -> list[Column]:
    """Equal-width bin number of each column, as columns named like the originals."""
    ranges = value_ranges(df, cols)
    return [
        _bin(F.col(c).cast("double"), *ranges.get(c, (0.0, 0.0)), bins).alias(c) for c in cols
    ]


@nan_is_missing
def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int) -> DataFrame:
    """``cols`` as bins of about equal counts: how many of the column's distinct inner quantiles lie below the value.

    Quantiles are exact; a value met at several of them makes fewer, larger bins. Null has no bin.
    """
    found: dict[str, list[float]] = {c: [] for c in cols}
    for r in exact_quantiles(df, cols, [i / bins for i in range(1, bins)]).collect():  # bins - 1 numbers per column
        found[r["feature"]].append(r["quantile"])
    above = {c: [float("-inf"), *(float(np.nextafter(q, np.inf)) for q in sorted(set(qs))), float("inf")] for c, qs in found.items()}
    edges = {c: e if len(e) > 2 else [float("-inf"), 0.0, float("inf")] for c, e in above.items()}
    binned = with_buckets(df.select(*cols), edges)
    return binned.select(*[F.when(F.col(c).isNotNull(), F.col("_b_" + c)).cast("bigint").alias(c) for c in cols])


@nan_is_missing
def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """(feature, bin, lo, hi, n) equal-width histogram of the non-null values; empty bins are absent."""
    ranges = value_ranges(df, cols)
    cols = [c for c in cols if c in ranges]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                _bin(F.col(c).cast("double"), *ranges[c], bins).alias("bin"),
            )
            for c in cols
        ]
    )
    counts = df.select(F.inline(cells)).where("bin IS NOT NULL").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    width = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit((ranges[c][1] - ranges[c][0]) / bins))])
    low = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(ranges[c][0]))])
    start = low[F.col("feature")] + F.col("bin") * width[F.col("feature")]
    return counts.select("feature", "bin", start.alias("lo"), (start + width[F.col("feature")]).alias("hi"), "n")


@nan_is_missing
def grid_density(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Counts on a bins x bins grid over rows where both columns are present."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    bx, by = bin_columns(both, [x, y], bins)
    return both.select(bx.alias("x_bin"), by.alias("y_bin")).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


@nan_is_missing
def hex_density(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Counts per hexagon: each point goes to the nearer of two offset lattices of centres."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranges = value_ranges(both, [x, y])
    if not ranges:
        return both.select(F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0).cast("bigint").alias("n")).limit(0)
    rows = max(1, int(gridsize / 3**0.5))

    def scaled(c: str, n: int) -> Column:
        lo, hi = ranges[c]
        return (F.col(c).cast("double") - lo) / F.lit(((hi - lo) or 1.0) / n)

    u, v = scaled(x, gridsize), scaled(y, rows)
    near = (F.rint(u), F.rint(v))
    off = (F.floor(u) + 0.5, F.floor(v) + 0.5)
    d = [(u - a) * (u - a) + 3 * (v - b) * (v - b) for a, b in (near, off)]
    first = d[0] < d[1]
    cx, cy = F.when(first, near[0]).otherwise(off[0]), F.when(first, near[1]).otherwise(off[1])
    (xl, xh), (yl, yh) = ranges[x], ranges[y]
    return (
        both.select(cx.alias("u"), cy.alias("v"))
        .groupBy("u", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            (F.lit(xl) + F.col("u") * ((xh - xl) / gridsize)).alias("cx"),
            (F.lit(yl) + F.col("v") * ((yh - yl) / rows)).alias("cy"),
            "n",
        )
    )
