"""Incremental CSV to Parquet conversion with a report."""

from __future__ import annotations

import os
from collections.abc import Collection

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import path_status, read_csv, size_bytes


def _csv_files(spark: SparkSession, source: str) -> list[tuple[str, str, int, int]]:
    """(table, path, bytes, modified) of every CSV or gzipped CSV in a folder."""
    fs, p = path_status(spark, source)
    found = {}
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        for ext in (".csv.gz", ".csv"):
            if name.endswith(ext):
                table = name[: -len(ext)]
                # a plain CSV wins over its gzipped twin
                if table not in found or ext == ".csv":
                    found[table] = (table, st.getPath().toString(), st.getLen(), st.getModificationTime())
                break
    return [found[t] for t in sorted(found)]


def _is_fresh(spark: SparkSession, target: str, source_time: int) -> bool:
    """Converted completely, and after the source last changed."""
    fs, done = path_status(spark, f"{target}/_SUCCESS")
    return fs.exists(done) and fs.getFileStatus(done).getModificationTime() > source_time


def convert_tables(
    spark: SparkSession,
    source: str,
    target: str,
    schemas: dict | None = None,
    force: bool = False,
    single_line: Collection[str] = (),
) -> DataFrame:
    """Convert each CSV to snappy Parquet; one failing table does not stop the others.

    ``single_line`` names tables known to have no line breaks inside fields, which saves the scan for them. A
    table counts as converted only if as many rows come back as were read.
    """
    report = []
    for table, path, csv_bytes, modified in _csv_files(spark, source):
        out = os.path.join(target, f"{table}.parquet")
        if not force and _is_fresh(spark, out, modified):
            report.append((table, "skipped", None, csv_bytes, size_bytes(spark, out), None))
            continue
        try:
            seen = Observation()
            wide = 2 * spark.sparkContext.defaultParallelism
            df = read_csv(spark, path, (schemas or {}).get(table), wide, False if table in single_line else None).observe(seen, F.count(F.lit(1)).alias("n"))
            df.write.mode("overwrite").option("compression", "snappy").parquet(out)
            rows = spark.read.parquet(out).count()
            if rows != seen.get["n"]:
                raise RuntimeError(f"{seen.get['n']} rows read, {rows} written")
            report.append((table, "converted", rows, csv_bytes, size_bytes(spark, out), None))
        except Exception as e:  # noqa: BLE001 - reported per table
            report.append((table, "error", None, csv_bytes, None, " ".join(str(e).split())[:500]))
    frame = spark.createDataFrame(
        report, "table string, status string, rows long, csv_bytes long, parquet_bytes long, error string"
    )
    ratio = (1 - F.try_divide(F.col("parquet_bytes"), F.col("csv_bytes"))) * 100
    return frame.withColumn("pct_smaller", F.round(ratio, 1))
