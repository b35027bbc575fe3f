"""Exact Kendall tau-b for all column pairs by a tree of value ranges.

The points of a pair are one group. A group of more than ROWS_PER_GROUP points is cut into ranges of
both coordinates. A pair of points is discordant either (a) across ranges of both, counted from the range x range
histogram, which has at most (2 x MOST_RANGES) squared cells, (b) inside one range of the first, or (c)
inside one range of the second but across ranges of the first. (b) and (c) are groups of their
own, (c) with the number of the range as its first coordinate; they are cut again while they are too
large and counted by merging otherwise. Every cut divides a group, so neither rows nor ranges have a
limit. Equal points are one with a weight, and a group with one value on either side holds no
discordant pair and goes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import nan_is_missing
from ..session import cut_lineage

ROWS_PER_GROUP = 1 << 19
MOST_RANGES = 512  # with the hot values' own ranges at most 1,024


def weighted_inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> float:
    """Sum of w_i * w_j over pairs with first_i < first_j and second_i > second_j.

    Splits the ranks of ``second`` bit by bit: at each level, ones met before zeros inside
    a group with the same higher bits are inversions.
    """
    order = np.lexsort((second, first))
    ranks = np.unique(second, return_inverse=True)[1][order].astype(np.int64)
    w = weight[order].astype(np.float64)
    total = 0.0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        group = ranks >> (bit + 1)
        one = (ranks >> bit) & 1
        ones = np.cumsum(w * one)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.where(starts > 0, ones[starts - 1], 0.0)
        base = np.repeat(base, np.diff(np.r_[starts, len(ranks)]))
        total += float(np.sum(np.where(one == 0, w * (ones - base), 0.0)))
        move = np.argsort(ranks >> bit, kind="stable")
        ranks, w = ranks[move], w[move]
    return total


def _grid_discordant(pdf: pd.DataFrame) -> pd.DataFrame:
    """Discordant weight between cells that differ in both ranges."""
    h = np.zeros((pdf["bx"].max() + 1, pdf["by"].max() + 1))
    h[pdf["bx"], pdf["by"]] = pdf["c"]
    below_left = np.zeros_like(h)
    # cells with smaller bx and larger by than (bx, by)
    above = h[:, ::-1].cumsum(axis=1)[:, ::-1]
    below_left[1:, :-1] = above.cumsum(axis=0)[:-1, 1:]
    return pd.DataFrame({"pair": [int(pdf["pair"].iloc[0])], "q": [float((h * below_left).sum())]})


def _group_inversions(pdf: pd.DataFrame) -> pd.DataFrame:
    q = weighted_inversions(pdf["first"].to_numpy(), pdf["second"].to_numpy(), pdf["c"].to_numpy())
    return pd.DataFrame({"pair": [int(pdf["pair"].iloc[0])], "q": [q]})


def _ranges(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Range of each value; an edge met several times is a hot value with a range of its own."""
    unique, times = np.unique(edges, return_counts=True)
    inner = np.unique(np.concatenate([unique, np.nextafter(unique[times > 1], np.inf)]))
    return np.searchsorted(inner, values, side="right").astype(np.int32)


def _split(points: DataFrame, groups: DataFrame, limit: int, most: int) -> DataFrame:
    """``points`` of the large ``groups`` with their ranges ``bx`` and ``by``."""
    largest = groups.agg(F.max("n")).first()[0]
    ranges = int(min(most, max(2, -(-2 * largest // limit))))
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    inside = points.join(F.broadcast(groups.select("pair", "part")), ["pair", "part"])
    accuracy = F.lit(20 * ranges)
    edges = inside.groupBy("pair", "part").agg(F.percentile_approx("first", probs, accuracy).alias("ex"), F.percentile_approx("second", probs, accuracy).alias("ey"))
    # a row per group of more than ``limit`` points; rows do not carry the edges
    cuts = {(r["pair"], r["part"]): (np.array(r["ex"]), np.array(r["ey"])) for r in edges.toLocalIterator()}
    shared = points.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, part, first, second = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "part", "first", "second")]
            order = np.lexsort((part, pair))
            starts = np.flatnonzero(np.r_[True, (np.diff(pair[order]) != 0) | (np.diff(part[order]) != 0)]) if len(order) else []
            bx, by = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
            for rows in np.split(order, starts[1:]) if len(order) else []:
                group = (int(pair[rows[0]]), int(part[rows[0]]))
                ex, ey = shared.value[group]
                bx[rows], by[rows] = _ranges(ex, first[rows]), _ranges(ey, second[rows])
            names = ["pair", "part", "first", "second", "c"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bx), pa.array(by)], names=[*names, "bx", "by"])

    schema = "pair int, part long, first double, second double, c double, bx int, by int"
    return inside.select("pair", "part", "first", "second", "c").mapInArrow(cut, schema)


def discordant(points: DataFrame, limit: int = ROWS_PER_GROUP, most: int = MOST_RANGES) -> DataFrame:
    """(pair, q): weight of the discordant pairs among (pair, first, second, c) points, each point once."""
    work, found = points.withColumn("part", F.lit(0).cast("long")), []
    while True:
        stats = work.groupBy("pair", "part").agg(
            F.count(F.lit(1)).alias("n"), F.min("first").alias("a"), F.max("first").alias("b"), F.min("second").alias("y"), F.max("second").alias("z")
        )
        # a row per group
        groups = cut_lineage(stats.where("a < b AND y < z").select("pair", "part", "n"))
        small = work.join(groups.where(F.col("n") <= limit).select("pair", "part"), ["pair", "part"])
        found.append(small.groupBy("pair", "part").applyInPandas(_group_inversions, "pair int, q double"))
        large = groups.where(F.col("n") > limit)
        if large.isEmpty():
            break
        cut = cut_lineage(_split(work, large, limit, most))
        grid = cut.groupBy("pair", "part", "bx", "by").agg(F.sum("c").alias("c"))
        found.append(grid.groupBy("pair", "part").applyInPandas(_grid_discordant, "pair int, q double"))
        below = lambda kind, bucket: (F.col("part") * 2 + kind) * 1024 + F.col(bucket)
        by_first = cut.select("pair", below(0, "bx").alias("part"), "first", "second", "c")
        by_second = cut.groupBy("pair", below(1, "by").alias("part"), F.col("bx").cast("double").alias("first"), "second").agg(F.sum("c").alias("c"))
        work = cut_lineage(by_first.unionByName(by_second))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("pair").agg(F.sum("q").alias("q"))


@nan_is_missing
def kendall_pairs(df: DataFrame, cols: Sequence[str], limit: int = ROWS_PER_GROUP, most: int = MOST_RANGES) -> DataFrame:
    """(x, y, tau, n) for every pair x before y in ``cols``; rows with a null in the pair are left out."""
    pairs = [(a, b) for a in range(len(cols)) for b in range(a + 1, len(cols))]
    wide = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)])
    points = F.array(
        *[F.struct(F.lit(p).alias("pair"), F.col(f"c{a}").alias("first"), F.col(f"c{b}").alias("second")) for p, (a, b) in enumerate(pairs)]
    )
    cells = (
        wide.select(F.inline(points))
        .where(F.col("first").isNotNull() & F.col("second").isNotNull())
        .groupBy("pair", "first", "second")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )

    # several aggregates read the cells: keep them once
    cells = cut_lineage(cells)

    def choose2(c: Column) -> Column:
        return c * (c - 1) / 2

    n1 = cells.groupBy("pair", "first").agg(F.sum("c").alias("t"))
    n2 = cells.groupBy("pair", "second").agg(F.sum("c").alias("t"))
    ties_x = n1.groupBy("pair").agg(F.sum(choose2(F.col("t"))).alias("n1"))
    ties_y = n2.groupBy("pair").agg(F.sum(choose2(F.col("t"))).alias("n2"))
    base = cells.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(choose2(F.col("c"))).alias("n3"))
    inversions = discordant(cells, limit, most)

    n0 = choose2(F.col("n"))
    score = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.coalesce("q", F.lit(0.0))
    scale = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    joined = base.join(ties_x, "pair").join(ties_y, "pair").join(inversions, "pair", "left")

    def side(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(cols[p[k]]) for p in pairs]), F.col("pair") + 1)

    return joined.select(
        side(0).alias("x"), side(1).alias("y"), F.try_divide(score, scale).alias("tau"), F.col("n").cast("bigint").alias("n")
    )
