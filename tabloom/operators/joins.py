"""Equi-joins with explicit rules for null keys, colliding names and hot keys."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import suffix_collisions
from ..functions.rng import key_hash
from ..session import shuffle_width


def left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | str, suffix: str = "_right", null_keys_match: bool = False
) -> DataFrame:
    """Left join on key columns; colliding right-hand names get ``suffix``.

    With ``null_keys_match`` a null key equals a null key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    right = suffix_collisions(right, left.columns, keys, suffix)
    if not null_keys_match:
        return left.join(right, keys, "left")
    other = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(other)
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    return left.join(right, same, "left").drop(*other.values())


def join_available(
    left: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], null_keys_match: bool = False
) -> DataFrame:
    """Fold left joins over tables, each on those of its keys both sides have; keyless tables are skipped."""
    for name, (right, keys) in tables.items():
        usable = [k for k in keys if k in left.columns and k in right.columns]
        if usable:
            left = left_join(left, right, usable, f"_{name.lower()}", null_keys_match)
    return left


def outer_combine(
    tables: Mapping[str, DataFrame], preferred: Sequence[Sequence[str]], order_key: Mapping[str, str] | None = None
) -> DataFrame:
    """Full outer join of several tables on the first key set of ``preferred`` that both sides have.

    Without a common key the tables are zipped on their position along ``order_key``.
    """
    names = list(tables)
    out = tables[names[0]]
    for name in names[1:]:
        right = tables[name]
        keys = next((list(k) for k in preferred if set(k) <= set(out.columns) & set(right.columns)), None)
        if keys:
            out = full_outer(out, suffix_collisions(right, out.columns, keys, f"_{name}"), keys)
        else:
            if not order_key:
                raise ValueError(f"no common key with {name}; pass order_key to align rows by position")
            out = zip_by_order(out, right, order_key[names[0]], order_key[name], f"_{name}")
    return out


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join as inner join plus the unmatched rows of each side.

    Adaptive execution splits a hot key in these joins, which it cannot in a full outer one. Rows
    with a null key match nothing and take no part in a shuffle for their key.
    """
    keys = list(keys)
    whole = [functools.reduce(lambda a, b: a & b, [side[f"`{k}`"].isNotNull() for k in keys]) for side in (left, right)]
    left_full, right_full = left.where(whole[0]), right.where(whole[1])
    left_more, right_more = ([c for c in side.columns if c not in keys] for side in (left, right))
    both = left_full.join(right_full, keys, "inner")
    left_only = left_full.join(right_full.select(*keys).distinct(), keys, "left_anti").unionByName(left.where(~whole[0]))
    right_only = right_full.join(left_full.select(*keys).distinct(), keys, "left_anti").unionByName(right.where(~whole[1]))
    rows = both.unionByName(left_only, allowMissingColumns=True).unionByName(right_only, allowMissingColumns=True)
    return rows.select(*keys, *left_more, *right_more)


def zip_by_order(
    left: DataFrame, right: DataFrame, left_order: str, right_order: str, suffix: str = "_right"
) -> DataFrame:
    """Pair the i-th row of each side along a unique numeric order column."""
    from .ranking import row_positions

    a = row_positions(left, left_order, "position")
    b = row_positions(suffix_collisions(right, left.columns, [], suffix), _renamed(right, left, right_order, suffix), "position")
    return a.join(b, "position", "full_outer")


def _renamed(right: DataFrame, left: DataFrame, col: str, suffix: str) -> str:
    return col + suffix if col in left.columns else col


def lookup(facts: DataFrame, dictionary: DataFrame, keys: Sequence[str] | str, suffix: str = "_dict") -> DataFrame:
    """Dictionary lookup. No forced broadcast: the planner broadcasts when the measured size allows it."""
    return left_join(facts, dictionary, keys, suffix)


def semi_filter(facts: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts whose keys occur on the spine."""
    return facts.join(spine.select(*keys).dropna().distinct(), list(keys), "left_semi")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def hot_keys(df: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """The ``width`` most frequent keys: any key above a 1/width share of the rows is among them."""
    width = width or 4 * max(shuffle_width(df.sparkSession), 8)
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > 1).orderBy(F.desc("_n"), *keys).limit(width).select(*keys)


def skew_safe_left_join(
    big: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot: DataFrame,
) -> DataFrame:
    """Left join against a side that is unique on ``keys`` when some keys hold a large share of ``big``.

    Rows with a hot (or null) key are spread over all tasks by the ``spread`` columns and
    served from the few hot entries, which are broadcast; every other row takes the
    ordinary shuffle. ``hot`` lists the hot keys (see :func:`hot_keys` for its bound).
    """
    keys = list(keys)
    payload = [c for c in unique.columns if c not in keys]
    marked = hot.select(*keys).withColumn("_is_hot", F.lit(True))
    few = unique.join(F.broadcast(marked), keys, "inner").drop("_is_hot")
    probe = big.join(F.broadcast(marked), keys, "left")
    return _split_lookup(probe, F.col("_is_hot").isNotNull(), few, unique, keys, payload, spread).select(
        *big.columns, *payload
    )


def edge_lookup(
    big: DataFrame, unique: DataFrame, keys: Sequence[str], spread: Sequence[str], flag: str
) -> DataFrame:
    """As :func:`skew_safe_left_join` where both sides carry a boolean column that marks possible hot keys.

    The flagged entries must be few (bucket edges are), because they are broadcast.
    """
    keys = list(keys)
    payload = [c for c in unique.columns if c not in (*keys, flag)]
    few = unique.where(F.col(flag)).drop(flag)
    rest = unique.where(~F.col(flag)).drop(flag)
    return _split_lookup(big, F.col(flag), few, rest, keys, payload, spread).select(*big.columns, *payload)


def _split_lookup(
    probe: DataFrame, is_hot: Column, few: DataFrame, rest: DataFrame, keys: list[str], payload: list[str],
    spread: Sequence[str],
) -> DataFrame:
    null_key = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted = probe.withColumn(
        "_salt", F.when(null_key | is_hot, key_hash(list(spread), 7)).otherwise(F.lit(0).cast("bigint"))
    )
    few = few.select(*keys, F.struct(*payload).alias("_hot"))
    cold = rest.select(*keys, F.lit(0).cast("bigint").alias("_salt"), F.struct(*payload).alias("_cold"))
    joined = salted.join(F.broadcast(few), keys, "left").join(cold, [*keys, "_salt"], "left")
    kept = [F.col(c) for c in probe.columns]
    return joined.select(*kept, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in payload])
