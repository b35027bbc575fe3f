"""Samples and splits that depend on the row key and a seed, not on partitioning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import key_hash, key_uniform
from ..sources.readers import read_table
from .ranking import positions


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest key hash.

    A threshold on the hash leaves a little more than ``n`` candidates; these are numbered in the
    order of their hash by a distributed sort, so no task holds them all.
    """
    total = df.count()
    if total <= n:
        return df
    share = (n + 8.0 * math.sqrt(n) + 32.0) / total
    few = df.where(key_uniform(key, seed) < F.lit(share)) if share < 1.0 else df
    u = key_uniform(key, seed)
    placed = positions(few.withColumn("_u", u), ["_u", *key], "_position", unique=False)
    return placed.where(F.col("_position") < n).drop("_u", "_position")


def load_sample(spark: SparkSession, path: str, key: Sequence[str], max_rows: int, seed: int = 42) -> DataFrame:
    """A sample of at most ``max_rows`` rows of a file or folder, read by its extension."""
    return sample_rows(read_table(spark, path), key, max_rows, seed)


def split_rows(
    df: DataFrame, key: Sequence[str], shares: Mapping[str, float] | None = None, seed: int = 42
) -> DataFrame:
    """Add ``split``; a key keeps its split whatever else is in the table."""
    shares = shares or {"train": 0.6, "val": 0.2, "test": 0.2}
    u, names, upto = key_uniform(key, seed), list(shares), 0.0
    label = None
    for name in names[:-1]:
        upto += shares[name]
        label = F.when(u < upto, name) if label is None else label.when(u < upto, name)
    return df.withColumn("split", F.lit(names[-1]) if label is None else label.otherwise(names[-1]))


def replicate(df: DataFrame, times: int, name: str = "rep") -> DataFrame:
    """Each row ``times`` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42, position: str | None = None) -> DataFrame:
    """A seeded permutation (a distributed sort on the key hash); ``position`` adds each row's new place."""
    if position is None:
        return df.orderBy(key_hash(key, seed), *key)
    return positions(df.withColumn("_h", key_hash(key, seed)), ["_h", *key], position, unique=False).drop("_h").orderBy(position)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, prob) over non-null labels."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(label)).first()[0]
    return counts.withColumn("prob", F.try_divide(F.col("n"), F.lit(total)))


def draw_labels(ids: DataFrame, id_col: str, probs: Mapping, seed: int = 42, name: str = "label") -> DataFrame:
    """Give each id a label drawn with the stated probabilities."""
    u, upto, expr, labels = key_uniform([id_col], seed), 0.0, None, list(probs)
    for lab in labels[:-1]:
        upto += probs[lab]
        expr = F.when(u < upto, F.lit(lab)) if expr is None else expr.when(u < upto, F.lit(lab))
    return ids.withColumn(name, F.lit(labels[-1]) if expr is None else expr.otherwise(F.lit(labels[-1])))
