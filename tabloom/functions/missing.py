"""One notion of "missing": NaN becomes null before anything is aggregated."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every float/double column."""
    fixed = {
        f.name: F.when(F.isnan(F.col(f"`{f.name}`")), None).otherwise(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fixed) if fixed else df


def nan_is_missing(operator: Callable) -> Callable:
    """An operator that sees NaN in its first argument, a DataFrame, as null."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        return operator(normalize_missing(df), *args, **kwargs)

    return run


def missing_to_category(col: str | Column, label: str = "missing") -> Column:
    """Cast to string; null and the text "nan" become ``label``."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    return F.coalesce(F.when(F.lower(text) == "nan", None).otherwise(text), F.lit(label))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def missing_ratio(cols: Sequence[str]) -> Column:
    """Share of ``cols`` that is null in the row."""
    total = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return total / F.lit(float(len(cols)))


def filter_missing_rows(df: DataFrame, cols: Sequence[str], max_ratio: float | None = 0.5) -> DataFrame:
    """Keep rows whose missing ratio is at most ``max_ratio``; ``None`` keeps all."""
    if max_ratio is None:
        return df
    return df.where(missing_ratio(cols) <= F.lit(max_ratio))


def missing_filter_report(df: DataFrame, cols: Sequence[str], max_ratio: float = 0.5) -> DataFrame:
    """One row: how many rows the missing-ratio filter keeps and drops."""
    dropped = F.count_if(missing_ratio(cols) > F.lit(max_ratio))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        dropped.alias("n_filtered"),
        F.round(F.try_divide(dropped, F.count(F.lit(1))) * 100, 6).alias("pct_filtered"),
    )


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))
