"""Association between columns of any type, as long (x, y, statistic, n) frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.missing import nan_is_missing, normalize_missing
from ..functions.pvalues import chi2_pvalue, f_pvalue
from ..session import cut_lineage
from .gram import bounded, names, pearson_pairs
from .kendall import kendall_pairs
from .ranking import Ranking, ranked_cells, ranked_together, task_count, wide_ranks

COUNTED_ROWS = 200_000  # rows whose level numbers a task holds before it counts them
HELD_CELLS = 2_000_000
TOGETHER = 32  # partners of a column whose ranks one sort gives


def corr_matrix(
    df: DataFrame, cols: Sequence[str], method: str = "pearson", key: Sequence[str] | None = None
) -> DataFrame:
    """(x, y, r, n) over all pairs with x at or before y; nulls are left out pair by pair."""
    if method == "pearson":
        return pearson_pairs(df, cols).select("x", "y", "r", "n")
    if method == "spearman":
        if not key:
            raise ValueError("spearman needs the row key")
        return spearman_pairs(df, key, cols)
    if method == "kendall":
        return kendall_pairs(df, cols).withColumnRenamed("tau", "r")
    raise ValueError(method)


def _columns_with_nulls(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def spearman_pairs(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson of average ranks. A pair with nulls is ranked again on the rows both sides have."""
    cols = list(cols)
    df = cut_lineage(normalize_missing(df.select(*dict.fromkeys([*key, *cols]))))
    gaps = set(_columns_with_nulls(df, cols))
    full = [c for c in cols if c not in gaps]
    parts = []
    if len(full) > 1:
        # average ranks of a complete column have this mean, so the ranks are computed once
        middle = (df.count() + 1) / 2
        ranks = wide_ranks(df, key, full, keep_key=False)
        parts.append(pearson_pairs(ranks, full, middle).select("x", "y", "r", "n"))
    with_gaps = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :] if a in gaps or b in gaps]
    if with_gaps:
        parts.append(_spearman_on_shared_rows(df, key, with_gaps))
    single = [c for c in cols if c in gaps or len(full) == 1]
    if single:
        own = F.array(
            *[
                F.struct(
                    F.lit(c).alias("x"), F.lit(c).alias("y"),
                    F.when(F.min(c) != F.max(c), F.lit(1.0)).alias("r"), F.count(c).alias("n"),
                )
                for c in single
            ]
        )
        parts.append(df.agg(own.alias("s")).select(F.inline("s")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _spearman_on_shared_rows(df: DataFrame, key: Sequence[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Both sides of each pair ranked on the rows that have both; a column is sorted once for up to TOGETHER partners."""
    ids = [f"_k{i}" for i in range(len(key))]
    named = df.withColumns({i: F.col(k) for i, k in zip(ids, key)})
    partners: dict[str, list[str]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    rankings = [(c, own[i : i + TOGETHER]) for c, own in partners.items() for i in range(0, len(own), TOGETHER)]
    place = {(c, o): (i, j) for i, (c, own) in enumerate(rankings) for j, o in enumerate(own)}
    cells = ranked_together(named, [(c, [F.col(c).isNotNull() & F.col(o).isNotNull() for o in own]) for c, own in rankings], ids)
    repeated = F.raise_error(F.lit(f"{', '.join(key)} names more than one row")).cast("array<double>")
    mine = [F.when(F.col("ranking") == i, F.col("ranks")) for i in range(len(rankings))]
    rows = cells.repartition(task_count(df, len(rankings)), *ids).groupBy(*ids).agg(
        *[F.when(F.count(m) > 1, repeated).otherwise(F.max(m)).alias(f"r{i}") for i, m in enumerate(mine)]
    )

    def rank(c: str, other: str) -> Column:
        i, j = place[c, other]
        return F.col(f"r{i}")[j]

    sides = F.array(*[F.struct(F.lit(p).alias("pair"), rank(a, b).alias("rx"), rank(b, a).alias("ry")) for p, (a, b) in enumerate(pairs)])
    spread = (F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry"))
    r = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    both = rows.select(F.inline(sides)).where("rx IS NOT NULL")
    sums = both.groupBy("pair").agg(F.when(spread, r).alias("r"), F.count(F.lit(1)).alias("n"))

    def side_name(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)

    found = sums.select(side_name(0).alias("x"), side_name(1).alias("y"), bounded(F.col("r")).alias("r"), "n")
    return with_all_pairs(found, pairs, "r")


def with_all_pairs(found: DataFrame, pairs: Sequence[tuple[str, str]], value: str) -> DataFrame:
    """``found`` (x, y, value, n) with a null value and n = 0 for pairs without shared rows."""
    wanted = found.sparkSession.createDataFrame(list(pairs), "x string, y string")
    # a row per pair of columns
    return wanted.join(found, ["x", "y"], "left").select("x", "y", value, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def mirror(pairs: DataFrame, value: str) -> DataFrame:
    """Full symmetric long matrix from the upper triangle."""
    flipped = pairs.where(F.col("x") != F.col("y")).select(F.col("y").alias("x"), F.col("x").alias("y"), value)
    return pairs.select("x", "y", value).unionByName(flipped)


def to_matrix(pairs: DataFrame, value: str, cols: Sequence[str]) -> DataFrame:
    """Wide presentation: one row per x, one column per y."""
    return pairs.groupBy("x").agg(*[F.max(F.when(F.col("y") == c, F.col(value))).alias(c) for c in cols])


# --- categorical x categorical ---------------------------------------------------------


class PairCounts:
    """Counts of level pairs of all columns two by two, for the rows of one task.

    Levels get numbers as they come, so a column is an array of small integers and a pair's counts are sums
    over one array of cells. A task holds HELD_CELLS cells; beyond it what it has so far goes out.
    """

    def __init__(self, columns: int) -> None:
        self.codes: list[dict[str, int]] = [{} for _ in range(columns)]
        self.cells: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.held: list[list[np.ndarray]] = [[] for _ in range(columns)]
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for k, column in enumerate(batch.columns):
            coded = column.dictionary_encode()
            own = self.codes[k]
            numbers = np.array([own.setdefault(v, len(own)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)
            self.held[k].append(numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)])
        self.rows += batch.num_rows

    def sum_up(self) -> None:
        columns = [np.concatenate(h) if h else np.zeros(0, np.int64) for h in self.held]
        for i, x in enumerate(columns):
            for j in range(i + 1, len(columns)):
                y = columns[j]
                both = (x >= 0) & (y >= 0)
                keys, counts = np.unique(x[both] << 32 | y[both], return_counts=True)
                if (i, j) in self.cells:
                    old, n = self.cells[i, j]
                    keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    counts = np.bincount(at, weights=np.concatenate([n, counts])).astype(np.int64)
                self.cells[i, j] = keys, counts
        self.held, self.rows = [[] for _ in columns], 0

    def size(self) -> int:
        return sum(len(k) for k, _ in self.cells.values())

    def out(self) -> Iterator[pa.RecordBatch]:
        names = [pa.array(list(c), pa.string()) for c in self.codes]
        for (i, j), (keys, counts) in self.cells.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), i, np.int32)), pa.array(np.full(len(keys), j, np.int32)),
                    names[i].take(pa.array(keys >> 32)), names[j].take(pa.array(keys & 0xFFFFFFFF)), pa.array(counts.astype(float)),
                ],
                names=["i", "j", "vx", "vy", "o"],
            )
        self.__init__(len(names))


def contingency(df: DataFrame, cols: Sequence[str], null_level: str | None = "0.0") -> DataFrame:
    """(i, j, vx, vy, o) counts for all pairs i < j in one scan.

    Missing values count as the level ``null_level``; with ``None`` they are left out pair by pair.
    A task adds its rows up in arrays and sends levels x levels rows for each pair at most, never a row
    for each pair of columns of a row.
    """
    levels = []
    for k, c in enumerate(cols):
        v = F.col(c).cast("string")
        levels.append((F.coalesce(v, F.lit(null_level)) if null_level is not None else v).alias(f"c{k}"))

    width = len(levels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts(width)
        for batch in batches:
            counts.add(batch)
            if counts.rows >= COUNTED_ROWS:
                counts.sum_up()
                if counts.size() > HELD_CELLS:
                    yield from counts.out()
        counts.sum_up()
        yield from counts.out()

    parts = df.select(*levels).mapInArrow(count, "i int, j int, vx string, vy string, o double")
    return parts.groupBy("i", "j", "vx", "vy").agg(F.sum("o").alias("o"))


def _with_margins(cells: DataFrame) -> DataFrame:
    return (
        cells.withColumn("r", F.sum("o").over(W.partitionBy("i", "j", "vx")))
        .withColumn("c", F.sum("o").over(W.partitionBy("i", "j", "vy")))
    )


def _pair_names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("x", names(cols, "i")).withColumn("y", names(cols, "j"))


def contingency_table(df: DataFrame, cols: Sequence[str], null_level: str | None = "0.0") -> DataFrame:
    cells = _pair_names(contingency(df, cols, null_level), cols)
    return cells.select("x", "y", F.col("vx").alias("x_level"), F.col("vy").alias("y_level"), F.col("o").cast("bigint").alias("n"))


def cramers_v_matrix(
    df: DataFrame, cols: Sequence[str], bias_correction: bool = True, yates: bool = True, null_level: str | None = "0.0"
) -> DataFrame:
    """(x, y, v, n) for x before y; null when either side has a single level.

    ``yates`` applies the continuity correction to 2 x 2 tables.
    """
    m = _with_margins(contingency(df, cols, null_level))
    totals = m.groupBy("i", "j").agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("ssq"),
        F.round(F.sum(F.col("o") / F.col("r"))).alias("rows"),
        F.round(F.sum(F.col("o") / F.col("c"))).alias("cols"),
        F.sum(F.col("o") / (F.col("r") * F.col("r"))).alias("inv_r"),
        F.sum(F.col("o") / (F.col("c") * F.col("c"))).alias("inv_c"),
        F.first(F.struct("o", "r", "c")).alias("cell"),
    )
    n, rows, k = F.col("n"), F.col("rows"), F.col("cols")
    chi2 = n * (F.col("ssq") - 1)
    if yates:
        gap = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.c") / n)
        shrunk = gap - F.least(F.lit(0.5), gap)
        two_by_two = shrunk * shrunk * n * F.col("inv_r") * F.col("inv_c")
        chi2 = F.when((rows == 2) & (k == 2), two_by_two).otherwise(chi2)
    phi2 = F.greatest(F.lit(0.0), chi2 / n)
    if bias_correction:
        phi2 = F.greatest(F.lit(0.0), phi2 - F.try_divide((k - 1) * (rows - 1), n - 1))
        rows_c = rows - F.try_divide((rows - 1) * (rows - 1), n - 1)
        k_c = k - F.try_divide((k - 1) * (k - 1), n - 1)
    else:
        rows_c, k_c = rows, k
    v = F.when((rows > 1) & (k > 1), F.sqrt(F.try_divide(phi2, F.least(k_c - 1, rows_c - 1))))
    return _pair_names(totals, cols).select(
        "x", "y", bounded(v, 0.0).alias("v"), n.cast("bigint").alias("n")
    )


def theils_u_matrix(df: DataFrame, cols: Sequence[str], null_level: str | None = "0.0") -> DataFrame:
    """(x, y, u): share of the entropy of x that y explains, for every ordered pair; 1 on the diagonal.

    Entropies are written over raw counts (ln n minus the mean log count), so one aggregate
    per pair gives them without dividing every cell by the total first.
    """
    m = _with_margins(contingency(df, cols, null_level))
    o = F.col("o")
    sums = m.groupBy("i", "j").agg(
        F.sum("o").alias("n"),
        F.sum(o * F.log("o")).alias("o_ln_o"), F.sum(o * F.log("r")).alias("o_ln_r"), F.sum(o * F.log("c")).alias("o_ln_c"),
    )
    n = F.col("n")
    h = _pair_names(sums, cols).select(
        "x", "y",
        (F.log(n) - F.col("o_ln_r") / n).alias("hx"), (F.log(n) - F.col("o_ln_c") / n).alias("hy"),
        ((F.col("o_ln_c") - F.col("o_ln_o")) / n).alias("hx_y"), ((F.col("o_ln_r") - F.col("o_ln_o")) / n).alias("hy_x"),
    )

    def explained(total: str, left: str) -> Column:
        return F.when(F.col(total) < 1e-12, F.lit(1.0)).otherwise((F.col(total) - F.col(left)) / F.col(total))

    one = h.select("x", "y", explained("hx", "hx_y").alias("u"))
    two = h.select(F.col("y").alias("x"), F.col("x").alias("y"), explained("hy", "hy_x").alias("u"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "x string, y string, u double")
    return one.unionByName(two).unionByName(diagonal)


def count_entropy(counts: DataFrame, by: str, n: str, name: str) -> DataFrame:
    """Entropy in nats of each group of (level, count) rows."""
    o = F.col(n).cast("double")
    sums = counts.groupBy(by).agg(F.sum(o).alias("_n"), F.sum(o * F.log(o)).alias("_s"))
    return sums.select(by, F.greatest(F.lit(0.0), F.log("_n") - F.col("_s") / F.col("_n")).alias(name))


def entropies(df: DataFrame, cols: Sequence[str], null_level: str | None = "0.0") -> DataFrame:
    """(feature, entropy) in nats."""
    levels = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit(null_level)).alias("level"))
            for c in cols
        ]
    )
    counts = df.select(F.inline(levels)).groupBy("feature", "level").agg(F.count(F.lit(1)).alias("o"))
    return count_entropy(counts, "feature", "o", "entropy")


# --- categorical x numeric -------------------------------------------------------------


def _by_level(df: DataFrame, cats: Sequence[str], nums: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """Fan rows out over the categorical columns only; numeric values stay columns."""
    levels = F.array(*[F.struct(F.lit(c).alias("cat"), F.col(c).cast("string").alias("level")) for c in cats])
    return df.select(*cols, F.inline(levels)).where(F.col("level").isNotNull())


@nan_is_missing
def anova_f(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(cat, num, f, p, groups, n) one-way ANOVA; needs two non-empty groups."""
    rows = _by_level(df, cats, nums, [F.col(c).cast("double").alias(c) for c in nums])
    aggs = []
    for k, c in enumerate(nums):
        aggs += [F.count(c).alias(f"n{k}"), F.avg(c).alias(f"m{k}"), F.var_pop(c).alias(f"v{k}")]
    wide = rows.groupBy("cat", "level").agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("num"), F.col(f"n{k}").alias("n"), F.col(f"m{k}").alias("m"), F.col(f"v{k}").alias("v"))
            for k, c in enumerate(nums)
        ]
    )
    groups = wide.select("cat", F.inline(cells)).where("n > 0")
    n, m = F.col("n"), F.col("m")
    grand = F.sum(n * m).over(W.partitionBy("cat", "num")) / F.sum(n).over(W.partitionBy("cat", "num"))
    sums = (
        groups.withColumn("grand", grand)
        .groupBy("cat", "num")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("n"),
            F.sum(n * (m - F.col("grand")) * (m - F.col("grand"))).alias("ssb"),
            F.sum(n * F.col("v")).alias("ssw"),
        )
        .where("groups > 1")
    )
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    out = sums.select("cat", "num", f.alias("f"), d1.cast("double").alias("d1"), d2.cast("double").alias("d2"), "groups", "n")
    return out.select("cat", "num", "f", f_pvalue("f", "d1", "d2").alias("p"), "groups", "n")


def kruskal_h(df: DataFrame, cats: Sequence[str], nums: Sequence[str]) -> DataFrame:
    """(cat, num, h, p, groups, n) Kruskal-Wallis with tie correction.

    A column is ranked once for all categories without nulls, and once more for each with nulls, on the rows that
    have it. Ranks are summed by level inside tasks; only cells travel, never a cell for each category.
    """
    safe = {c: f"_level{i}" for i, c in enumerate(cats)}  # a category may be called like another column
    levels = [F.col(f"`{c}`").cast("string").alias(s) for c, s in safe.items()]
    df = cut_lineage(normalize_missing(df.select(*nums, *levels)))
    gaps = set(_columns_with_nulls(df, list(safe.values())))
    shared = [c for c in cats if safe[c] not in gaps]
    wanted: list[tuple[str, list[str], Ranking]] = [(n, shared, Ranking(n)) for n in nums if shared]
    wanted += [(n, [c], Ranking(n, F.col(safe[c]).isNotNull())) for c in cats if safe[c] in gaps for n in nums]
    if not wanted:
        wanted = [(n, [], Ranking(n)) for n in nums]
    cells = ranked_cells(df, [w[2] for w in wanted], list(safe.values()))
    fanned = [
        F.struct(F.array_contains(F.array(*[F.lit(i) for i, w in enumerate(wanted) if c in w[1]] or [F.lit(-1)]), F.col("ranking")).alias("own"),
                 F.lit(c).alias("cat"), F.col(safe[c]).alias("level"))
        for c in cats
    ]
    t = F.col("ties").cast("double")
    by_level = (
        cells.select("ranking", "avg_rank", "ties", F.inline(F.array(*fanned)))
        .where(F.col("own") & F.col("level").isNotNull())
        .groupBy("ranking", "cat", "level")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("avg_rank").alias("r"), F.sum(t * t - 1).alias("tie"))
    )
    num = F.element_at(F.array(*[F.lit(w[0]) for w in wanted]), F.col("ranking") + 1)
    sums = (
        by_level.groupBy("ranking", "cat")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("n"),
            F.sum(F.col("r") * F.col("r") / F.col("n")).alias("ssr"),
            F.sum("tie").alias("tie"),
        )
        .where("groups > 1")
    )
    total = F.col("n")
    raw = 12.0 / (total * (total + 1)) * F.col("ssr") - 3 * (total + 1)
    h = F.try_divide(raw, 1 - F.try_divide(F.col("tie"), total * total * total - total))
    out = sums.select(
        "cat", num.alias("num"), h.alias("h"), (F.col("groups") - 1).cast("double").alias("dof"), "groups", total.cast("bigint").alias("n")
    )
    return out.select("cat", "num", "h", chi2_pvalue("h", "dof").alias("p"), "groups", "n")
