"""Child-table aggregates: counts, statistics and item pivots per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..functions.missing import nan_is_missing


def child_counts(child: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows per key as ``<name>_count``; rows with a null key belong to no parent."""
    return child.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_count"))


@nan_is_missing
def child_stats(child: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """count, mean, sample std, min and max of ``value`` per key."""
    v = F.col(value)
    return child.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(v).alias(f"{name}_count"),
        F.avg(v).alias(f"{name}_mean"),
        F.stddev_samp(v).alias(f"{name}_std"),
        F.min(v).alias(f"{name}_min"),
        F.max(v).alias(f"{name}_max"),
    )


@nan_is_missing
def item_means(child: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    return child.dropna(subset=[*keys, item]).groupBy(*keys, item).agg(F.avg(value).alias("mean_value"))


def item_frequency(child: DataFrame, item: str) -> DataFrame:
    return child.dropna(subset=[item]).groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def top_items(child: DataFrame, item: str, k: int = 50) -> DataFrame:
    """The ``k`` most frequent items; equal counts are ordered by item."""
    return item_frequency(child, item).orderBy(F.desc("n"), F.col(item)).limit(k)


def only_top_items(child: DataFrame, item: str, k: int = 50) -> DataFrame:
    """Rows of the ``k`` most frequent items; the list is ``k`` rows, so it is broadcast."""
    return child.join(F.broadcast(top_items(child, item, k).select(item)), item, "left_semi")


@nan_is_missing
def pivot_items(
    child: DataFrame,
    keys: Sequence[str],
    item: str,
    value: str,
    name: str,
    top: int = 50,
    drop_empty: bool = True,
    items: Sequence | None = None,
) -> DataFrame:
    """Mean of ``value`` per key with one column per frequent item.

    Only the item list (at most ``top`` values) reaches the driver. ``drop_empty`` leaves out
    items without any value and keys without any value among the chosen items.
    """
    if items is None:
        counted = (
            child.dropna(subset=[item])
            .groupBy(item)
            .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"))
            .orderBy(F.desc("n"), F.col(item))
            .limit(top)
            .collect()
        )
        items = [r[item] for r in counted if r["n_values"] > 0 or not drop_empty]
    items = sorted(items)
    rows = child.dropna(subset=list(keys)).where(F.col(item).isin(items))
    if drop_empty:
        rows = rows.where(F.col(value).isNotNull())
    # conditional averages instead of groupBy.pivot: one aggregation with map-side partials
    cells = [F.avg(F.when(F.col(item) == F.lit(i), F.col(value))).alias(f"{name}_{item}_{i}") for i in items]
    return rows.groupBy(*keys).agg(*cells) if cells else rows.select(*keys).distinct()


@nan_is_missing
def value_shares(df: DataFrame, col: str, k: int | None = 5) -> DataFrame:
    """Share of each non-null value, the ``k`` largest first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(col)).first()[0]
    out = counts.select(F.col(col).alias("level"), "n", F.try_divide(F.col("n"), F.lit(total)).alias("share"))
    out = out.orderBy(F.desc("n"), "level")
    return out.limit(k) if k else out


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))


@nan_is_missing
def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: n, mean, sample std, sample variance, population std, min, max."""
    stats = [
        F.struct(
            F.lit(c).alias("feature"),
            F.count(quoted(c)).alias("n"),
            F.avg(quoted(c)).alias("mean"),
            F.stddev_samp(quoted(c)).alias("std"),
            F.var_samp(quoted(c)).alias("var"),
            F.stddev_pop(quoted(c)).alias("std_pop"),
            F.min(quoted(c).cast("double")).alias("min"),
            F.max(quoted(c).cast("double")).alias("max"),
        )
        for c in cols
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Row concatenation by name; columns a frame lacks become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot_values(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Wide to long (feature, value), without null values."""
    wide = df.select(*ids, *[quoted(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(ids), [f"`{c}`" for c in cols], "feature", "value").where(F.col("value").isNotNull())
