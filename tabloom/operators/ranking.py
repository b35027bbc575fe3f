"""Global ranks and exact quantiles without a single-partition sort.

Buckets are value ranges taken from approximate quantiles; they only balance the work, the ranks
are exact for any bucket edges. Inside a bucket a window ranks; the buckets' own totals (a few
numbers per feature) give the offset. A value that fills several quantiles gets a bucket to itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import nan_is_missing, normalize_missing
from ..session import cut_lineage, shuffle_width

BUCKET_ROWS = 500_000  # about as many rows as one window ranks, and cells as one task takes
BRACKET_ERROR = 0.001  # rank error of the approximate quantiles around a wanted one
BRACKET_ROWS = 5_000_000  # most values of one bracket that are ranked in one task


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the shuffle has partitions, and more once the rows need them."""
    return max(shuffle_width(df.sparkSession), 4, -(-df.count() // BUCKET_ROWS))


def task_count(df: DataFrame, cells: int) -> int:
    """Partitions for ``cells`` cells of each row: as many as the shuffle has, and more once the cells need them."""
    return max(shuffle_width(df.sparkSession), -(-df.count() * cells // BUCKET_ROWS))


def bucket_edges(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> dict[str, list[float]]:
    """Strictly increasing edges from -inf to +inf per column, near-equal in row counts."""
    buckets = buckets or bucket_count(df)
    return edges_at(df, cols, [i / buckets for i in range(1, buckets)], 0.5 / buckets)


def edges_at(df: DataFrame, cols: Sequence[str], probs: Sequence[float], error: float) -> dict[str, list[float]]:
    """Edges at approximate quantiles; a value met at several of them gets a bucket of its own."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    quantiles = doubles.approxQuantile(list(cols), list(probs), error) if probs else [[] for _ in cols]
    edges = {}
    for c, q in zip(cols, quantiles):
        values, repeats = np.unique(np.asarray(q, dtype=float), return_counts=True)
        own = np.nextafter(values[repeats > 1], np.inf)
        inner = np.unique(np.concatenate([values, own])) + 0.0
        inner = inner[np.isfinite(inner)]
        if not len(inner):  # an all-null column, or one bucket asked for: any cut is right
            inner = np.zeros(1)
        edges[c] = [float("-inf"), *[float(v) for v in inner], float("inf")]
    return edges


def with_buckets(df: DataFrame, edges: dict[str, list[float]], prefix: str = "_b_") -> DataFrame:
    """Add ``<prefix><col>`` with the bucket number; columns become doubles without -0.0."""
    cols = list(edges)
    doubles = df.withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in cols})
    binned = Bucketizer(
        splitsArray=[edges[c] for c in cols],
        inputCols=cols,
        outputCols=[prefix + c for c in cols],
        handleInvalid="keep",
    ).transform(doubles)
    return binned.withColumns({prefix + c: F.col(prefix + c).cast("int") for c in cols})


def long_values(
    df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., feature, bucket, value) rows of the cells that are present.

    Buckets come from doubles. Where a column is bigint or decimal, values are pairs of the double
    and the exact number, so that numbers beyond 2**53 stay apart.
    """
    edges = bucket_edges(df, cols)
    exact = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, (T.LongType, T.DecimalType))]
    whole = {c: F.col(c).cast("decimal(38,9)") for c in exact}
    binned = with_buckets(df.withColumns({"_x_" + c: v for c, v in whole.items()}), edges)

    def value(c: str) -> Column:
        if not exact:
            return F.col(c)
        number = F.col("_x_" + c) if c in exact else F.lit(None).cast("decimal(38,9)")
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("d"), number.alias("x")))

    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col("_b_" + c).alias("bucket"), value(c).alias("value"))
            for c in cols
        ]
    )
    return binned.select(*keep, F.inline(cells)).where(F.col("value").isNotNull() & F.col("bucket").isNotNull())


def rank_counts(counts: DataFrame, group: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Add ``ties``, ``before`` (smaller values) and ``total`` to rows (group..., bucket, value, n).

    Several rows may share a value (for instance one per level); they share ties and before.
    """
    group = list(group)
    part = [*group, "bucket"]
    # stated on both branches below, so that they stay identical and share one shuffle
    for c in (*part, value):
        counts = counts.where(F.col(c).isNotNull())
    running = W.partitionBy(*part).orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*part).orderBy(value).rangeBetween(W.currentRow, W.currentRow)
    totals = counts.groupBy(*part).agg(F.sum(n).alias("_in_bucket"))
    by_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    upto = by_group.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *part,
        F.coalesce(F.sum("_in_bucket").over(upto), F.lit(0)).alias("_offset"),
        F.sum("_in_bucket").over(by_group).alias("total"),
    )
    inside = counts.withColumn("ties", F.sum(n).over(same)).withColumn(
        "before", F.sum(n).over(running) - F.col("ties")
    )
    # one row per (group, bucket)
    out = inside.join(offsets, part, "inner")
    return out.withColumn("before", F.col("before") + F.col("_offset")).drop("_offset")


def average_rank() -> Column:
    return F.col("before") + (F.col("ties") + 1) / 2


def rank_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per (feature, distinct value): bucket, value, n, ties, before, total."""
    counts = long_values(df, cols).groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    return rank_counts(counts, ["feature"])


@dataclass(frozen=True)
class Ranking:
    """One ranking of a column: all rows, or those where ``where`` holds."""

    col: str
    where: Column | None = None


def _in_ranges(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str], Callable[[str], Column]]:
    """``df`` with the value range of each column, its bigint and decimal columns, and whether a cell's range holds one value."""
    edges = bucket_edges(df, cols)
    exact = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, (T.LongType, T.DecimalType))]
    whole = {"_x_" + c: F.col(c).cast("decimal(38,9)") for c in exact}
    binned = with_buckets(df.withColumns(whole) if whole else df, edges)

    def alone(c: str) -> Column:
        """Whether the cell's range holds one value by construction; doubles beyond 2**53 may stand for several numbers."""
        e = edges[c]
        own = [i for i in range(len(e) - 1) if np.nextafter(e[i], np.inf) == e[i + 1] and (c not in exact or abs(e[i]) < 2.0**53)]
        return F.col("_b_" + c).isin(own) if own else F.lit(False)

    return binned, exact, alone


def ranked_cells(df: DataFrame, rankings: Sequence[Ranking], keep: Sequence[str]) -> DataFrame:
    """(keep..., ranking, avg_rank, ties, n_valid): a row for each present cell of each ranking (its index).

    ``df`` is read twice, so it should be a written table. A first pass counts the cells of every value
    range; the counts, summed up along the ranges, say where each range's ranks begin. The second sends a
    cell to its range only, where a window ranks it. Ranges are quantiles, so a value with more than about
    one range's share of the rows has a range of its own: the counts alone give the rank of its
    cells, which stay where they are.
    """
    cols = list(dict.fromkeys(r.col for r in rankings))
    binned, exact, alone = _in_ranges(df, cols)

    def cell(i: int, r: Ranking) -> Column:
        here = F.col(r.col).isNotNull() if r.where is None else F.col(r.col).isNotNull() & r.where
        fields = [F.lit(i).alias("ranking"), F.when(here, F.col("_b_" + r.col)).alias("bucket"), F.col(r.col).alias("d"), alone(r.col).alias("alone")]
        if exact:
            fields.append((F.col("_x_" + r.col) if r.col in exact else F.lit(None).cast("decimal(38,9)")).alias("x"))
        return F.struct(*fields)

    cells = binned.select(*keep, F.inline(F.array(*[cell(i, r) for i, r in enumerate(rankings)]))).where("bucket IS NOT NULL")
    counts = cells.groupBy("ranking", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("ranking").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row per ranking and range
    starts = cut_lineage(
        counts.select(
            "ranking", "bucket", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("ranking")).alias("n_valid")
        )
    )
    placed = cells.join(starts, ["ranking", "bucket"])
    value = ["d", "x"] if exact else ["d"]
    inside = W.partitionBy("ranking", "bucket").orderBy(*value)
    same = W.partitionBy("ranking", "bucket", *value)
    shown = [*keep, "ranking", (F.col("start") + F.col("first") + (F.col("ties") - 1) / 2).alias("avg_rank"), "ties", "n_valid"]
    hot = placed.where("alone").withColumn("first", F.lit(1)).withColumn("ties", F.col("n"))
    rest = placed.where("NOT alone").repartition(task_count(df, len(rankings)), "ranking", "bucket")
    rest = rest.withColumn("first", F.rank().over(inside)).withColumn("ties", F.count(F.lit(1)).over(same))
    return hot.select(*shown).unionByName(rest.select(*shown))


def ranked_together(df: DataFrame, rankings: Sequence[tuple[str, Sequence[Column]]], keep: Sequence[str]) -> DataFrame:
    """(keep..., ranking, ranks): a row for each present cell of each (column, conditions) of ``rankings`` (its index).

    ``ranks`` has the average rank among the rows of each condition, null where the cell's own row is none of
    them. As ``ranked_cells``, but a column is sorted once for all its conditions, of which running sums are kept.
    """
    binned, exact, alone = _in_ranges(df, list(dict.fromkeys(c for c, _ in rankings)))
    width = max(len(conditions) for _, conditions in rankings)

    def cell(i: int, c: str, conditions: Sequence[Column]) -> Column:
        marks = [F.coalesce(w, F.lit(False)).cast("int") for w in conditions]
        here = reduce(Column.__or__, [m == 1 for m in marks])
        fields = [F.lit(i).alias("ranking"), F.when(F.col(c).isNotNull() & here, F.col("_b_" + c)).alias("bucket"), F.col(c).alias("d"), alone(c).alias("alone")]
        fields += [(marks[j] if j < len(marks) else F.lit(0)).alias(f"in{j}") for j in range(width)]
        if exact:
            fields.append((F.col("_x_" + c) if c in exact else F.lit(None).cast("decimal(38,9)")).alias("x"))
        return F.struct(*fields)

    cells = binned.select(*keep, F.inline(F.array(*[cell(i, c, w) for i, (c, w) in enumerate(rankings)]))).where("bucket IS NOT NULL")
    counts = cells.groupBy("ranking", "bucket").agg(*[F.sum(f"in{j}").alias(f"n{j}") for j in range(width)])
    upto = W.partitionBy("ranking").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row per ranking and range
    starts = cut_lineage(
        counts.select("ranking", "bucket", *[f"n{j}" for j in range(width)], *[F.coalesce(F.sum(f"n{j}").over(upto), F.lit(0)).alias(f"start{j}") for j in range(width)])
    )
    placed = cells.join(starts, ["ranking", "bucket"])
    value = ["d", "x"] if exact else ["d"]
    inside = W.partitionBy("ranking", "bucket").orderBy(*value).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("ranking", "bucket", *value)

    def ranks(upto: str, ties: str) -> Column:
        average = lambda j: F.col(f"start{j}") + F.col(f"{upto}{j}") - (F.col(f"{ties}{j}") - 1) / 2
        return F.array(*[F.when(F.col(f"in{j}") == 1, average(j)) for j in range(width)]).alias("ranks")

    hot = placed.where("alone").select(*keep, "ranking", ranks("n", "n"))
    rest = placed.where("NOT alone").repartition(task_count(df, len(rankings)), "ranking", "bucket")
    rest = rest.select("*", *[F.sum(f"in{j}").over(inside).alias(f"upto{j}") for j in range(width)])
    rest = rest.select("*", *[F.sum(f"in{j}").over(same).alias(f"ties{j}") for j in range(width)])
    return hot.unionByName(rest.select(*keep, "ranking", ranks("upto", "ties")))


def wide_ranks(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], percent: bool = False, keep_key: bool = True
) -> DataFrame:
    """Key plus one rank column per feature (ties averaged, nulls stay null).

    A key that names two rows raises an error. The projected input is written once.
    """
    df = cut_lineage(normalize_missing(df.select(*dict.fromkeys([*key, *cols]))))
    ids = [f"_k{i}" for i in range(len(key))]
    named = df.withColumns({i: F.col(k) for i, k in zip(ids, key)})
    cells = ranked_cells(named, [Ranking(c) for c in cols], ids)
    cell = F.col("avg_rank")
    if percent:
        cell = cell / F.col("n_valid") * 100
    repeated = F.raise_error(F.lit(f"{', '.join(key)} names more than one row")).cast("double")
    mark = cells.select(*ids, "ranking", cell.alias("rank"))
    # a row without any value has no cell; this one keeps it, and tells a key of two rows
    rows = named.select(*ids, F.lit(-1).alias("ranking"), F.lit(None).cast("double").alias("rank"))
    wide = mark.unionByName(rows).repartition(task_count(df, len(cols) + 1), *ids).groupBy(*ids).agg(
        *[
            F.when(F.count(F.when(F.col("ranking") == -1, 1)) > 1, repeated).otherwise(F.max(F.when(F.col("ranking") == i, F.col("rank")))).alias(c)
            for i, c in enumerate(cols)
        ]
    )
    if not keep_key:
        return wide.drop(*ids)
    return wide.select(*[F.col(i).alias(k) for i, k in zip(ids, key)], *cols)


def quantile_ranks(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Percentile rank x 100 of every numeric cell; ``key`` must identify a row."""
    return wide_ranks(df, key, cols, percent=True)


@nan_is_missing
def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(feature, prob, quantile) with linear interpolation between order statistics.

    Approximate quantiles on both sides of every wanted one cut each column into narrow
    brackets. Counting rows per bracket says exactly which brackets hold the wanted positions;
    only their values, a fraction of a percent of the column, are shuffled and ranked.
    """
    cols, probs = list(cols), [float(p) for p in dict.fromkeys(probs)]
    near = sorted({min(1.0, max(0.0, p + s * 2 * BRACKET_ERROR)) for p in probs for s in (-1, 1)})
    binned = with_buckets(df.select(*cols), edges_at(df, cols, near, BRACKET_ERROR))
    sizes: dict[str, dict[int, int]] = {}
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), F.col("_b_" + c)).alias("bucket")) for c in cols]
    )
    held = binned.select(F.inline(cells)).where("bucket IS NOT NULL").groupBy("feature", "bucket").count()
    for r in held.collect():  # at most 4 x probs + 1 rows per column
        sizes.setdefault(r["feature"], {})[r["bucket"]] = r["count"]

    targets, keep = [], {c: set() for c in cols}
    for c, size in sizes.items():
        order, total = sorted(size), sum(size.values())
        for p in probs:
            spot = (total - 1) * p
            for side, at in (("lo", math.floor(spot)), ("hi", math.ceil(spot))):
                below = 0
                for b in order:
                    if at < below + size[b]:
                        break
                    below += size[b]
                keep[c].add(b)
                targets.append([c, b, p, spot - math.floor(spot), side, at - below])
    narrow = binned.select(
        *[F.when(F.col("_b_" + c).isin(sorted(keep[c])), F.col(c)).alias(c) for c in cols],
        *["_b_" + c for c in cols],
    )
    largest = max((sizes[c][b] for c in sizes for b in keep[c]), default=0)
    if largest <= BRACKET_ROWS:
        rows = narrow.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("feature"), F.col("_b_" + c).alias("bucket"), F.col(c).alias("value"))
                        for c in cols
                    ]
                )
            )
        ).where("value IS NOT NULL")
        counts = rows.groupBy("feature", "bucket", "value").agg(F.count(F.lit(1)).alias("ties"))
        upto = W.partitionBy("feature", "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
        ranks = counts.withColumn("before", F.sum("ties").over(upto) - F.col("ties"))
        on = ["feature", "bucket"]
    else:
        # a bracket too large for one task: rank the kept values as a table of their own
        ranks, on = rank_table(narrow.select(*cols), cols), ["feature"]
        for t in targets:
            t[5] += sum(sizes[t[0]][b] for b in keep[t[0]] if b < t[1])
    wanted = df.sparkSession.createDataFrame(
        targets, "feature string, bucket int, prob double, frac double, side string, position bigint"
    ).select("prob", "frac", "side", "position", *on)
    found = ranks.join(F.broadcast(wanted), on).where("before <= position AND position < before + ties")
    ends = found.groupBy("feature", "prob", "frac").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("hi"),
    )
    return ends.select(
        "feature", "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("quantile")
    )


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per feature with a named column per probability."""
    long = exact_quantiles(df, cols, list(probs.values()))
    return long.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in probs.items()]
    )


POSITION_ROWS = 1_000_000  # rows of one range


def positions(df: DataFrame, order: Sequence[str], name: str = "position", unique: bool = True) -> DataFrame:
    """Zero-based position of each row in the order of its ``order`` columns, of any sortable type.

    Sampled ranges spread the sort and are written with their rows; their counts, one row per
    range, say where each range starts. Ranges grow in number with the rows. With ``unique``, two
    rows alike in ``order`` raise an error when the result is read.
    """
    order = list(order)
    width = max(shuffle_width(df.sparkSession), -(-df.count() // POSITION_ROWS))
    ranged = cut_lineage(df.repartitionByRange(width, *order).withColumn("__range", F.spark_partition_id()))
    inside = W.partitionBy("__range").orderBy(*order)
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    place = F.row_number().over(inside) - 1
    if unique:
        again = F.lag(F.struct(*order)).over(inside).eqNullSafe(F.struct(*order)) & (place > 0)
        place = F.when(again, F.raise_error(F.lit(f"{', '.join(order)} repeats a value")).cast("int")).otherwise(place)
    # one row per range
    placed = ranged.withColumn("__place", place).join(F.broadcast(starts), "__range")
    return placed.withColumn(name, F.col("__place") + F.col("__start")).drop("__place", "__start", "__range")


def row_positions(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Zero-based position of each row along a unique column without nulls."""
    if df.select(order).where(F.col(order).isNull()).limit(1).count():
        raise ValueError(f"{order} has nulls")
    return positions(df, [order], name)
