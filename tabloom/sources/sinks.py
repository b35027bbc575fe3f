"""Writers for wide tables, previews, manifests and result bundles."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def preview(df: DataFrame, order: Sequence[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def write_preview(df: DataFrame, path: str, order: Sequence[str], n: int = 1000) -> str:
    return write_table(preview(df, order, n), path)


def column_manifest(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def write_results(results: Mapping[str, DataFrame | None], folder: str) -> list[str]:
    """One Parquet folder per named result; keys stay ordinary columns."""
    return [
        write_table(df, os.path.join(folder, f"{name}.parquet")) for name, df in results.items() if df is not None
    ]
