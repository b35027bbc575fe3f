"""Numeric feature vectors for the multivariate detectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import valid_columns
from .profile import fitted_stats


def one_hot(
    df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), max_levels: int = 50, binary_single: bool = True
) -> DataFrame:
    """``keep`` plus ``<col>_<level>`` 0/1 columns; missing values are a level of their own.

    Levels are sorted; a column with two levels keeps only the second one.
    """
    from ..functions.missing import missing_to_category

    text = {c: missing_to_category(c) for c in cols}
    cells = F.array(*[F.struct(F.lit(c).alias("col"), text[c].alias("level")) for c in cols])
    # the group limit is applied before the shuffle, so a wide column cannot flood the driver
    place = F.row_number().over(W.partitionBy("col").orderBy("level"))
    found = df.select(F.inline(cells)).distinct().withColumn("place", place).where(F.col("place") <= max_levels + 1)
    levels: dict[str, list[str]] = {c: [] for c in cols}
    for r in found.select("col", "level").collect():
        levels[r["col"]].append(r["level"])
    for c, found_levels in levels.items():
        if len(found_levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        found_levels.sort()
    out = []
    for c in cols:
        used = levels[c][1:] if binary_single and len(levels[c]) == 2 else levels[c]
        out += [(text[c] == F.lit(v)).cast("double").alias(f"{c}_{v}") for v in used]
    return df.select(*keep, *out)


def feature_matrix(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], min_filled: float | None = 0.5, min_rows: int = 0
) -> tuple[DataFrame, list[str]] | None:
    """(key..., features array) of standardised complete rows over the usable columns.

    Usable columns vary and are mostly filled; rows with any null among them are dropped.
    ``None`` when no column or not more than ``min_rows`` rows remain.
    """
    used = valid_columns(df, cols, min_filled)
    if not used:
        return None
    doubles = df.dropna(subset=used).select(*key, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(used)])
    names = [f"_f{i}" for i in range(len(used))]
    stats = fitted_stats(doubles, names)
    if stats[names[0]]["n"] <= min_rows:
        return None
    vec = F.array(
        *[(F.col(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std_pop"] or 1.0) for c in names]
    )
    return doubles.select(*key, vec.alias("features")), used


def standardize_vectors(df: DataFrame, keep: Sequence[str], vec: str, dims: int) -> DataFrame:
    """Population-std scaling of an array column."""
    wide = df.select(*[F.col(vec)[i].cast("double").alias(f"f{i}") for i in range(dims)])
    stats = fitted_stats(wide, [f"f{i}" for i in range(dims)])
    mean = F.array(*[F.lit(stats[f"f{i}"]["mean"]) for i in range(dims)])
    std = F.array(*[F.lit(stats[f"f{i}"]["std_pop"] or 1.0) for i in range(dims)])
    centred = F.zip_with(F.col(vec).cast("array<double>"), mean, lambda a, b: a - b)
    return df.select(*keep, F.zip_with(centred, std, lambda a, b: a / b).alias("features"))


def pca_reduce(df: DataFrame, keep: Sequence[str], k: int, vec: str = "features") -> DataFrame:
    """First ``k`` principal components of an array column, on centred data."""
    first = df.select(F.size(vec).alias("d")).first()
    if first is None or first["d"] <= k:
        return df.select(*keep, F.col(vec).alias("features"))
    dims = first["d"]
    means = df.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dims)]).first()
    mean = F.array(*[F.lit(float(m)) for m in means])
    centred = df.select(
        *keep, array_to_vector(F.zip_with(F.col(vec).cast("array<double>"), mean, lambda a, b: a - b)).alias("_v")
    )
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    return model.transform(centred).select(*keep, vector_to_array("_p").alias("features"))


def as_matrix(column) -> np.ndarray:
    """Stack a pandas column of equal-length lists."""
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))
