"""Records of CSV files whose fields hold line breaks, read in splits instead of one task a file.

Whether a line begins inside quotes depends on all quotes before it. A first pass over the splits notes for each
whether its quotes are odd in number and whether its lines are well formed for either beginning; a few numbers a
split, summed up along each file, say how each begins. The second joins the lines of each record; the records
that lie across splits, at most one a split, are met by a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FILES_CONF = "spark.sql.files.minPartitionNum"

OPEN = r'"[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(?:{OPEN}"|[^",\r]*+)(?=,|\z)'
BEGUN_OUTSIDE = rf"\A(?:{FIELD}(?:,{FIELD})*+(?:,{OPEN})?|{OPEN})\z"
BEGUN_INSIDE = rf'\A[^"]*+(?:""[^"]*+)*+(?:"(?=,|\z)(?:,{FIELD})*+(?:,{OPEN})?)?\z'

RECORD, HEADER, FRAGMENT = 0, 1, 2
BLOCK_SCHEMA = (
    "file long, start long, odd boolean, turned boolean, bad_outside boolean, bad_inside boolean, cr_outside boolean, cr_inside boolean, "
    "head_cr boolean, head_bad boolean"
)
RECORD_SCHEMA = "value string, kind int, file long, owner long, start long"


@contextmanager
def _fixed_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike by the jobs inside, also while executors come and go."""
    if spark.conf.get(FILES_CONF, None) is not None:
        yield
        return
    spark.conf.set(FILES_CONF, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(FILES_CONF)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, start), from, to) of the rows of each split in a batch."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    if len(file):
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1]), True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield (int(file[a]), int(start[a])), int(a), int(b)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of BLOCK_SCHEMA for each split."""
    found: dict[tuple[int, int], dict] = {}
    for batch in batches:
        odd, outside, inside, cr, empty = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("odd", "outside", "inside", "cr", "empty")]
        for key, a, b in _runs(batch):
            if key not in found:
                found[key] = dict.fromkeys([f.split()[0] for f in BLOCK_SCHEMA.split(", ")], False)
                found[key] |= {"file": key[0], "start": key[1], "head_cr": bool(cr[a]), "head_bad": bool(odd[a] or empty[a])}
            block = found[key]
            after = np.logical_xor.accumulate(odd[a:b]) ^ block["odd"]  # what the quotes up to each line's end change
            before = after ^ odd[a:b]
            block["bad_outside"] |= bool((~np.where(before, inside[a:b], outside[a:b])).any())
            block["bad_inside"] |= bool((~np.where(before, outside[a:b], inside[a:b])).any())
            block["cr_outside"] |= bool((cr[a:b] & ~after).any())
            block["cr_inside"] |= bool((cr[a:b] & after).any())
            block["turned"] |= bool(after.any())
            block["odd"] = bool(after[-1])
    if found:
        yield pa.RecordBatch.from_pylist(list(found.values()))


def _beginnings(blocks: list) -> dict[tuple[int, int], tuple[bool, int, bool]] | None:
    """(begins inside quotes, start of the split where that record begins, lines end in CR LF) of each split.

    None if some file is not plainly formed, so that only a parser tells where its records end.
    """
    plan: dict[tuple[int, int], tuple[bool, int, bool]] = {}
    files: dict[int, list] = {}
    for b in blocks:
        files.setdefault(b["file"], []).append(b)
    for file, own in files.items():
        own.sort(key=lambda b: b["start"])
        if own[0]["start"] != 0 or own[0]["head_bad"]:
            return None
        crlf, inside, owner = own[0]["head_cr"], False, -1
        for b in own:
            if (file, b["start"]) in plan or b["bad_inside" if inside else "bad_outside"]:
                return None
            if not crlf and b["cr_inside" if inside else "cr_outside"]:
                return None
            plan[file, b["start"]] = inside, owner, crlf
            if not inside or b["turned"]:
                owner = b["start"]
            inside ^= b["odd"]
        if inside:
            return None
    return plan


class Joined:
    """Lines of one split joined to records; the ends of a record beyond the split are fragments."""

    def __init__(self, key: tuple[int, int], begins: tuple[bool, int, bool]) -> None:
        self.file, self.start = key
        self.inside, self.owner, self.crlf = begins
        self.inherited, self.headed, self.held = self.inside, self.start == 0, []

    def _batch(self, values: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(values)
        owner = self.owner if self.inherited else self.start
        numbers = [np.full(n, kind, np.int32), *[np.full(n, v, np.int64) for v in (self.file, owner, self.start)]]
        return pa.RecordBatch.from_arrays([values, *map(pa.array, numbers)], names=["value", "kind", "file", "owner", "start"])

    def add(self, lines: pa.Array, odd: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.crlf:
            lines = pc.replace_substring_regex(lines, r"\r\z", "")
        if self.headed:
            self.headed = False
            yield self._batch(lines.slice(0, 1), HEADER)
            lines, odd = lines.slice(1), odd[1:]
        if not len(odd):
            return
        after = np.logical_xor.accumulate(odd) ^ self.inside
        self.inside = bool(after[-1])
        ends = np.flatnonzero(~after) + 1
        if not len(ends):
            self.held += lines.to_pylist()
            return
        first = "\n".join([*self.held, *lines.slice(0, ends[0]).to_pylist()])
        yield self._batch(pa.array([first], pa.string()), FRAGMENT if self.inherited else RECORD)
        self.inherited = False
        rows = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), lines.slice(ends[0], ends[-1] - ends[0]))
        yield self._batch(pc.binary_join(rows, "\n"), RECORD)
        self.held = lines.slice(ends[-1]).to_pylist()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._batch(pa.array(["\n".join(self.held)], pa.string()), FRAGMENT)


def _numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    if lines.columns != ["value"]:  # columns from folder names
        return None
    value = F.make_valid_utf8("value")
    # the path of a file as a number: two alike would show as one split met twice
    at = lines.select(value.alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return at.withColumn("odd", F.col("value").contains('"') & odd)


def split_records(spark: SparkSession, paths: Sequence[str]) -> tuple[str, DataFrame] | None:
    """Header and (value) records of CSV files, or None where only a parser that reads whole files finds them.

    That is where a quote stands inside an unquoted field or text follows a closed one, a file ends inside quotes,
    line ends differ, or files differ in their headers. The records are written once.
    """
    lines = _numbered_lines(spark, paths)
    if lines is None:
        return None
    value = F.col("value")
    bare = F.when(value.endswith("\r"), F.regexp_replace("value", r"\r\z", "")).otherwise(value)
    plain = ~bare.contains('"') & ~bare.contains("\r")
    blank = (F.length(bare) > 0) & (F.length(F.trim(bare)) == 0)
    marks = lines.select(
        "file", "start", "odd", ((plain | bare.rlike(BEGUN_OUTSIDE)) & ~blank).alias("outside"), (~bare.contains('"') | bare.rlike(BEGUN_INSIDE)).alias("inside"),
        value.endswith("\r").alias("cr"), (F.length(bare) == 0).alias("empty"),
    )
    with _fixed_splits(spark):
        # a row for each split of a file
        plan = _beginnings(marks.mapInArrow(_scan, BLOCK_SCHEMA).collect())
        if not plan:
            return None

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, joined = None, None
            for batch in batches:
                odd = batch.column("odd").to_numpy(zero_copy_only=False)
                for new, a, b in _runs(batch):
                    if new != key:
                        if joined:
                            yield from joined.rest()
                        key, joined = new, Joined(new, plan[new])
                    yield from joined.add(batch.column("value").slice(a, b - a), odd[a:b])
            if joined:
                yield from joined.rest()

        written = cut_lineage(lines.mapInArrow(join, RECORD_SCHEMA))
    headers = written.where(F.col("kind") == HEADER).select("value").distinct().take(2)
    if len(headers) != 1:
        return None
    parts = F.array_sort(F.collect_list(F.struct("start", "value")))
    across = written.where(F.col("kind") == FRAGMENT).groupBy("file", "owner").agg(F.array_join(parts["value"], "\n").alias("value"))
    return headers[0]["value"], written.where(F.col("kind") == RECORD).select("value").unionByName(across.select("value"))


def _read(reader: DataFrameReader, records: DataFrame) -> DataFrame:
    """Spark's CSV reader over a table of records."""
    spark = records.sparkSession
    strings = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(strings), spark)


def parse_records(header: str, records: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Columns of the records; their types are inferred without a schema."""
    spark = records.sparkSession

    def reader() -> DataFrameReader:
        return spark.read.option("quote", '"').option("escape", '"').option("lineSep", "\n")

    if schema is None:
        first = spark.createDataFrame([(header,)], "value string")
        names = _read(reader().option("header", True), first).columns
        # a header no record is equal to
        mark = spark.createDataFrame([(",".join(f"{uuid.uuid4().hex}{i}" for i in range(len(names))),)], "value string")
        found = _read(reader().option("header", True).option("inferSchema", True), mark.unionByName(records)).schema
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, found.fields)])
    return _read(reader().schema(schema), records)
