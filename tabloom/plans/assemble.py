"""Assemble a star of tables into one wide analysis table."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import suffix_collisions
from ..operators.aggregates import child_counts, child_stats, pivot_items
from ..operators.joins import hot_keys, join_available, left_join, semi_filter, skew_safe_left_join
from ..operators.ranking import positions
from ..sources import catalog
from ..sources.sinks import column_manifest, write_preview, write_table


@dataclass(frozen=True)
class Child:
    """A many-per-spine-row table that is aggregated before it is joined."""

    name: str
    frame: DataFrame
    keys: Sequence[str]
    item: str | None = None
    value: str | None = None
    top: int = 50
    drop_empty: bool = True


def aggregate_child(child: Child, keys: Sequence[str]) -> DataFrame:
    """Item pivot if it has items and values, statistics if only values, else counts."""
    has = set(child.frame.columns)
    item = child.item if child.item in has else None
    value = child.value if child.value in has else None
    if item and value:
        return pivot_items(child.frame, keys, item, value, child.name, child.top, child.drop_empty)
    if value:
        return child_stats(child.frame, keys, value, child.name)
    return child_counts(child.frame, keys, child.name)


def assemble_wide(
    spine: DataFrame,
    dimensions: Sequence[tuple[DataFrame, Sequence[str], str]] = (),
    fan_out: Mapping[str, tuple[DataFrame, Sequence[str]]] | None = None,
    children: Sequence[Child] = (),
    grain: Sequence[str] | None = None,
    only_spine_keys: bool = False,
    null_keys_match: bool = False,
    spread: Sequence[str] | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Left-join dimensions, multiplying tables and aggregated children onto ``spine``.

    ``grain`` limits the keys children are grouped by (default: all keys the spine has).
    ``only_spine_keys`` drops child rows of other spines before aggregating; the result is
    the same. A child that cannot be analysed is reported and left out.

    ``spread`` names columns that tell spine rows apart. With it, keys that hold a large share
    of the spine are joined from a small broadcast while their rows stay spread over all tasks;
    dimensions must then have one row per key. Without it, adaptive execution splits skewed
    partitions of these left joins.

    ``row_id`` names a new column that numbers the rows in the order of all their columns. Joins
    that multiply spine rows leave no other key, and reports and detectors need one. Children have
    one row per key, so the number is given before they are attached.
    """
    wide = spine

    def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
        if not spread:
            return left_join(left, right, keys, suffix, null_keys_match)
        right = suffix_collisions(right, left.columns, keys, suffix)
        counted = spine if set(keys) <= set(spine.columns) else left
        return skew_safe_left_join(left, right, keys, spread, hot_keys(counted, keys))

    for frame, keys, suffix in dimensions:
        wide = attach(wide, frame, keys, suffix)
    wide = join_available(wide, fan_out or {}, null_keys_match)
    if row_id:
        sortable = [f"`{f.name}`" for f in wide.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        wide = positions(wide, sortable, row_id, unique=False)
    for child in children:
        keys = [k for k in child.keys if k in wide.columns and k in child.frame.columns]
        if grain is not None:
            keys = [k for k in keys if k in grain]
        if not keys:
            continue
        try:
            frame = child.frame
            if only_spine_keys:
                frame = semi_filter(frame, spine, [k for k in keys if k in spine.columns])
            ready = Child(child.name, frame, keys, child.item, child.value, child.top, child.drop_empty)
            wide = attach(wide, aggregate_child(ready, keys), keys, f"_{child.name.lower()}")
        except AnalysisException as e:
            warnings.warn(f"{child.name} left out: {" ".join(str(e).split())[:300]}", stacklevel=2)
    return wide


def assemble_clinical(
    spark: SparkSession,
    root: str,
    exclude: Iterable[str] = (),
    top: int = 50,
    grain: Sequence[str] | None = None,
) -> DataFrame:
    """Admissions with patients, ICU stays, services, transfers, child counts and item pivots."""
    tables = catalog.discover(spark, root, exclude=exclude)
    missing = [t for t in ("ADMISSIONS", "PATIENTS", "ICUSTAYS") if t not in tables]
    if missing:
        raise FileNotFoundError(f"required tables missing under {root}: {missing}")
    specs = {s.name: s for s in catalog.CLINICAL_TABLES}
    fan_out = {
        name: (tables[name], specs[name].keys) for name in ("SERVICES", "TRANSFERS") if name in tables
    }
    # ICU stays join on the admission, not on their own stay key
    first = [
        (tables["PATIENTS"], ["SUBJECT_ID"], "_pat"),
        (tables["ICUSTAYS"], ["SUBJECT_ID", "HADM_ID"], "_icu"),
    ]
    children = [
        Child(s.name, tables[s.name], s.keys, s.item_col, s.value_col or "VALUENUM", top)
        for role in ("child", "event")
        for s in catalog.specs_by_role(role)
        if s.name in tables
    ]
    return assemble_wide(tables["ADMISSIONS"], first, fan_out, children, grain)


def write_assembled(wide: DataFrame, folder: str, order: Sequence[str]) -> dict[str, str]:
    """Wide table, ordered preview and column manifest."""
    base = folder.rstrip("/")
    paths = {"combined": write_table(wide, f"{base}/combined.parquet")}
    saved = wide.sparkSession.read.parquet(paths["combined"])
    paths["sample"] = write_preview(saved, f"{base}/combined_sample.parquet", order)
    paths["columns"] = write_table(column_manifest(saved), f"{base}/combined_columns.parquet")
    return paths
