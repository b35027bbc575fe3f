"""Readers that prefer Parquet, fall back to (gzipped) CSV, and fail per table, not per job."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import normalize_missing
from .records import parse_records, split_records

WHOLE_BYTES = 32 << 20  # files with line breaks in fields of so much in all are read whole, larger ones in splits
SPREAD_BYTES = 16 << 20  # of a file read whole for each partition it is spread over


def path_status(spark: SparkSession, path: str):
    """Hadoop (FileSystem, Path) pair, so local, HDFS and object stores behave alike."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_status(spark, path)
    return fs.exists(p)


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, p = path_status(spark, path)
    return fs.getContentSummary(p).getLength()


def matched_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of all files and folders that ``paths``, which may hold wildcards, name."""
    total = 0
    for path in paths:
        fs, p = path_status(spark, path)
        total += sum(fs.getContentSummary(st.getPath()).getLength() for st in fs.globStatus(p) or [])
    return total


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return normalize_missing(spark.read.parquet(path))


def has_broken_fields(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether some field holds a line break: then a line ends inside quotes, and holds an odd number of them."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path if isinstance(path, str) else list(path)).where(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    partitions: int | None = None,
    multiline: bool | None = None,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """Header CSV with quoted fields, doubled quotes and line breaks inside quotes.

    Files are split. Where fields hold line breaks, the records of the splits are found first; ``multiline``
    says so, and without it a scan of the lines, itself split, finds out. Only gzip, files whose quotes do not
    tell where records end, and up to ``whole_bytes`` in all with line breaks are read whole, by one
    task each, and spread out again over ``partitions`` or more.
    """
    paths = [path] if isinstance(path, str) else list(path)
    zipped = any(p.endswith(".gz") for p in paths)
    if multiline is None:
        multiline = zipped or has_broken_fields(spark, paths)
    total = matched_bytes(spark, paths) if multiline else 0
    if multiline and not zipped and total > whole_bytes:
        found = split_records(spark, paths)
        if found is not None:
            return normalize_missing(parse_records(*found, schema))
    if not multiline and not (isinstance(path, str) and path.endswith(".gz")):
        partitions = None
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    if partitions:
        df = df.repartition(max(partitions, -(-total // SPREAD_BYTES)))
    return normalize_missing(df)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool | None = None
) -> DataFrame:
    """Read one path by its extension."""
    if path.endswith((".csv", ".csv.gz")):
        if not exists(spark, path):
            raise FileNotFoundError(path)
        return read_csv(spark, path, schema, 2 * spark.sparkContext.defaultParallelism, multiline)
    return read_parquet(spark, path)


def candidate_paths(root: str, name: str) -> list[str]:
    base = root.rstrip("/")
    return [
        f"{base}/parquet/{name}.parquet",
        f"{base}/{name}.parquet",
        f"{base}/{name}.csv",
        f"{base}/{name}.csv.gz",
    ]


def resolve_table(
    spark: SparkSession, root: str, name: str, on_missing: str = "raise", schema: T.StructType | str | None = None,
    multiline: bool | None = None,
) -> DataFrame | None:
    """Parquet if present, else CSV, else raise / warn / None according to ``on_missing``."""
    for path in candidate_paths(root, name):
        if exists(spark, path):
            return read_table(spark, path, schema, multiline)
    if on_missing == "raise":
        raise FileNotFoundError(f"{name} not found under {root}")
    if on_missing == "warn":
        warnings.warn(f"{name} not found under {root}; skipped", stacklevel=2)
    return None


def default_source(
    spark: SparkSession,
    root: str,
    path: str | None = None,
    combined: str = "combined/combined.parquet",
    fallback: str = "ADMISSIONS",
) -> DataFrame:
    """Explicit path, else the combined table, else the fallback table."""
    if path:
        return read_table(spark, path)
    combined_path = f"{root.rstrip('/')}/{combined}"
    if exists(spark, combined_path):
        return read_parquet(spark, combined_path)
    return resolve_table(spark, root, fallback)
