"""Association and anomaly reports: every result of one analysis as named DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, low_cardinality_cols, numeric_columns, quoted
from ..functions.missing import normalize_missing
from ..operators import associate, detectors, joint, neighbors, profile, ranking, rules
from ..operators.features import feature_matrix, one_hot, pca_reduce
from ..operators.ranking import positions
from ..session import cut_lineage

# Level limits, dimension limits, neighbour counts and shares of the analyses.
ASSOCIATION_LEVELS = 100
ANOMALY_LEVELS = 50
KNN_DIMS = 200
DETECTOR_DIMS = 50
KNN_K = 5
LOF_K = 20
CONTAMINATION = 0.1
NU = 0.1
MIN_ROWS = 100


def skipped_columns(df: DataFrame, skipped: dict[str, int], limit: int) -> DataFrame:
    """(column, levels, limit) of the categorical columns left out for having too many levels."""
    rows = [(c, n, limit) for c, n in sorted(skipped.items())]
    return df.sparkSession.createDataFrame(rows, "column string, levels long, limit int")


def association_report(
    df: DataFrame, key: Sequence[str], exclude: Sequence[str] = (), levels: int = ASSOCIATION_LEVELS
) -> dict[str, DataFrame]:
    """Numeric correlations, categorical associations and categorical-numeric tests.

    Kendall counts every discordant pair exactly; the other statistics are sums. Categorical columns
    with more than ``levels`` levels are listed in ``skipped_columns``. The columns are written once, as each result
    reads them.
    """
    skip = [*key, *exclude]
    nums, cats = numeric_columns(df, skip), categorical_columns(df, skip)
    df = cut_lineage(normalize_missing(df.select(*[quoted(c) for c in dict.fromkeys([*key, *nums, *cats])])))
    cats, wide = low_cardinality_cols(df, cats, levels)
    out: dict[str, DataFrame] = {"skipped_columns": skipped_columns(df, wide, levels)}
    if len(nums) > 1:
        out["pearson"] = associate.corr_matrix(df, nums, "pearson")
        out["spearman"] = associate.corr_matrix(df, nums, "spearman", key)
        out["kendall"] = associate.corr_matrix(df, nums, "kendall")
    if len(cats) > 1:
        out["cramers_v"] = associate.cramers_v_matrix(df, cats)
        out["theils_u"] = associate.theils_u_matrix(df, cats)
    if cats and nums:
        out["anova"] = associate.anova_f(df, cats, nums)
        out["kruskal"] = associate.kruskal_h(df, cats, nums)
    return out


def encoded_features(
    df: DataFrame, key: Sequence[str], exclude: Sequence[str] = (), levels: int = ANOMALY_LEVELS
) -> tuple[DataFrame, dict[str, int]]:
    """Key, numeric columns and one-hot columns of the low-cardinality categoricals; the skipped ones."""
    skip = [*key, *exclude]
    nums = numeric_columns(df, skip)
    cats, wide = low_cardinality_cols(df, categorical_columns(df, skip), levels)
    keep = [*key, *nums]
    return (one_hot(df, cats, keep, levels) if cats else df.select(*keep)), wide


def detector_scores(
    matrix: DataFrame, key: Sequence[str], seed: int = 42, knn: str = "exact", dims: int = DETECTOR_DIMS
) -> DataFrame:
    """Isolation forest, local outlier factor and one-class SVM side by side."""
    small = cut_lineage(pca_reduce(matrix, key, dims))
    if len(key) != 1:
        raise ValueError("neighbour search needs a single id column")
    scores = detectors.isolation_forest(small, key, contamination=CONTAMINATION, seed=seed)
    lof = neighbors.local_outlier_factor(small, key[0], "features", LOF_K, CONTAMINATION, knn)
    svm = detectors.one_class_svm(small, key, NU, seed=seed)
    return scores.join(lof, list(key)).join(svm, list(key))


def anomaly_report(
    df: DataFrame,
    key: Sequence[str],
    exclude: Sequence[str] = (),
    seed: int = 42,
    knn: str = "exact",
    levels: int = ANOMALY_LEVELS,
    knn_dims: int = KNN_DIMS,
    detector_dims: int = DETECTOR_DIMS,
) -> dict[str, DataFrame]:
    """Univariate scores, multivariate detectors, consensus, rules and joint statistics, with what plots need.

    Beyond ``knn_dims`` and ``detector_dims`` dimensions are reduced to principal components first.
    Columns with more than ``levels`` levels are listed in ``skipped_columns``. A key of several columns
    is numbered, and the results that name rows get its columns back.
    """
    if len(key) == 1:
        return _anomaly_report(normalize_missing(df), list(key), list(exclude), seed, knn, levels, knn_dims, detector_dims)
    numbered = cut_lineage(positions(normalize_missing(df), list(key), "_row"))
    out = _anomaly_report(numbered, ["_row"], [*key, *exclude], seed, knn, levels, knn_dims, detector_dims)
    ids = numbered.select("_row", *key)
    return {
        name: frame.join(ids, "_row").select(*key, *[c for c in frame.columns if c != "_row"]) if "_row" in frame.columns else frame
        for name, frame in out.items()
    }


def _anomaly_report(
    df: DataFrame, key: list[str], exclude: list[str], seed: int, knn: str, levels: int, knn_dims: int, detector_dims: int
) -> dict[str, DataFrame]:
    nums = numeric_columns(df, [*key, *exclude])
    encoded, wide = encoded_features(df, key, exclude, levels)
    encoded = cut_lineage(encoded)
    features = [c for c in encoded.columns if c not in key]
    out: dict[str, DataFrame] = {"skipped_columns": skipped_columns(df, wide, levels)}
    if nums:
        out["histograms"] = profile.histogram(df, nums)
        out["box_stats"] = profile.box_stats(df, nums)
        out["z_scores"] = profile.z_scores(df, nums, key)
        out["iqr_stats"] = profile.iqr_stats(df, nums)
        out["quantile_ranks"] = ranking.quantile_ranks(df, key, nums)
        out["rule_violations"] = rules.rule_flags(df, key)
        out["rule_counts"] = rules.rule_counts(df)
    distance = detectors.mahalanobis(encoded, key, features)
    thresholds = []
    if distance is not None:
        out["mahalanobis_distance"] = cut_lineage(distance)
        thresholds.append(detectors.score_threshold(out["mahalanobis_distance"], "mahalanobis"))
    fitted = feature_matrix(encoded, key, features, min_rows=MIN_ROWS)
    if fitted is not None:
        matrix = cut_lineage(fitted[0])
        near = neighbors.knn_distance(pca_reduce(matrix, key, knn_dims), key[0], "features", KNN_K, MIN_ROWS, knn)
        out["knn_distance"] = cut_lineage(near)
        thresholds.append(detectors.score_threshold(out["knn_distance"], "knn_distance"))
        out["anomaly_scores"] = cut_lineage(detector_scores(matrix, key, seed, knn, detector_dims))
        out["consensus"] = detectors.consensus_outliers(out["anomaly_scores"], key)
        out["consensus_counts"] = detectors.consensus_counts(out["consensus"])
    if thresholds:
        out["thresholds"] = reduce(DataFrame.unionByName, thresholds)
    if len(features) > 1:
        out["joint_correlation"] = cut_lineage(associate.corr_matrix(encoded, features, "pearson"))
        out["mutual_information"] = joint.mutual_information_matrix(encoded, features, "variance")
        out["joint_distribution_stats"] = joint.joint_stats(encoded, features, key)
        out["top_pairs"] = joint.top_pairs(out["joint_correlation"])
        grids = [
            profile.grid_density(encoded, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "x_bin", "y_bin", "n")
            for x, y in joint.pairs_to_show(out["joint_correlation"], features)
        ]
        out["pair_density"] = reduce(DataFrame.unionByName, grids)
    return out


def compare_real_synth(
    real: DataFrame, synth: DataFrame, nums: Sequence[str], cats: Sequence[str], k: int = 5
) -> dict[str, DataFrame]:
    """Numeric descriptions side by side, and the most frequent levels of each with their shares."""
    out: dict[str, DataFrame] = {}
    if nums:
        parts = [
            profile.describe_numeric(f, nums).withColumn("source", F.lit(name))
            for name, f in (("real", real), ("synthetic", synth))
        ]
        out["numeric"] = parts[0].unionByName(parts[1])
    for c in cats:
        out[f"levels_{c}"] = compare_levels(real, synth, c, k)
    return out


def compare_levels(real: DataFrame, synth: DataFrame, col: str, k: int = 5) -> DataFrame:
    """(level, real, synthetic) shares; a level missing from one side's top ``k`` counts as 0 there."""
    from ..operators.aggregates import value_shares

    a = value_shares(real, col, k).select("level", F.col("share").alias("real"))
    b = value_shares(synth, col, k).select("level", F.col("share").alias("synthetic"))
    both = a.join(b, "level", "full_outer")
    return both.select(
        "level",
        F.round(F.coalesce("real", F.lit(0.0)), 3).alias("real"),
        F.round(F.coalesce("synthetic", F.lit(0.0)), 3).alias("synthetic"),
    )
