"""Removal of multi-line chunks that the corpus repeats.

A text's lines (split at "\\n") are cut into chunks by content: a chunk ends behind a line where a
rolling hash over the last two line hashes has its two lowest bits clear, but never before two
lines and at the latest behind 32. Inserted or removed lines therefore move only the chunks around
them. A short repeated block seldom holds a whole chunk, so every two lines that follow each other
with nothing but wordless lines between them are a chunk of their own besides: a block of two or
more lines with words that the corpus repeats is covered by chunks from its first such line to its
last, wherever the cuts lie. Chunks with two or more lines that hold a word and with equal hashes are
compared byte by byte; of equal ones the first in the order of id, text hash and place stays, the
others go. Chunks overlap, so the kept copy may itself lose lines that a still earlier text holds:
every line that goes has an equal one at an earlier place that stays.

Only hashes travel for all chunks. Those whose hash repeats set two bits each in a filter of bounded size, and a second
pass over the texts sends the bytes of the chunks the filter knows. It also lets some others pass, whose bytes
are like no other's; no text travels whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage

LEAST_LINES = 2
MOST_LINES = 32
CUT_MASK = np.uint64(3)
BROADCAST_SPANS = 500_000  # 24 bytes each; beyond it the spans are joined by a shuffle
FILTER_BITS = (12, 27)  # log2 of the least and the greatest size of the filter, 16 MB
FILTER_SHIFTS = (0, 32)  # of the version, for the two bits of a chunk
BITS_A_CHUNK = 16
SLICE_BYTES = 256 << 10  # of text whose chunks a task holds at once
SPANS = "id long, version long, removed array<struct<first_line:int,n_lines:int,kept_id:bigint>>"
CHUNKS = "id long, version long, chunk int, first_line int, n_lines int, hash long"
HELD = CHUNKS + ", bytes string"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts and the number of lines of each text."""
    breaks = np.flatnonzero(data == 10)
    per_text = np.diff(np.searchsorted(breaks, offsets)) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, ends, per_text


def cut_places(rolled: list[int]) -> list[int]:
    """The first line of each chunk and the end, for one text's rolling hashes (1: cut behind)."""
    places, length = [0], 0
    for i, here in enumerate(rolled):
        length += 1
        if length >= MOST_LINES or (here and length >= LEAST_LINES):
            places.append(i + 1)
            length = 0
    if length:
        places.append(len(rolled))
    return places


def line_pairs(wordy: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each two neighbouring lines with words (``wordy``) of one text."""
    lines = np.flatnonzero(wordy)
    owner = np.repeat(np.arange(len(per_text)), per_text)[lines]
    same = owner[1:] == owner[:-1]
    return lines[:-1][same], lines[1:][same]


def known(bits: np.ndarray, version: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Whether both bits of a chunk are set in the filter ``bits``, 64 to a word."""
    high, out = np.uint64(64 * len(bits) - 1), np.ones(len(chunk), bool)
    for shift in FILTER_SHIFTS:
        at = ((version.view(np.uint64) >> np.uint64(shift)) ^ chunk.astype(np.uint64)) & high
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def chunk_batch(part: pa.RecordBatch, bits: np.ndarray | None = None) -> pa.RecordBatch:
    """CHUNKS of the texts, or HELD of those that the filter ``bits`` knows."""
    data, offsets = tx.flat(part.column("text"))
    starts, ends, per_text = line_spans(data, offsets)
    hashes = tx.span_hash(data, starts, ends)
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~tx.SPACE[data], out=worded[1:])
    wordy = np.concatenate([[0], np.cumsum(worded[ends] > worded[starts])])
    with np.errstate(over="ignore"):
        before = np.concatenate([[np.uint64(0)], hashes[:-1]])
        rolled = (tx.mix(hashes * tx.PLACE_CODE[0] + tx.mix(before + tx.PLACE_CODE[1])) & CUT_MASK) == 0
    rolled[np.cumsum(per_text) - per_text] = False  # a text's first line has no line before it
    flags, at = rolled.tolist(), 0
    begin, finish = [], []
    for n in per_text.tolist():
        places = cut_places(flags[at : at + n])
        begin += [at + p for p in places[:-1]]
        finish += [at + p - 1 for p in places[1:]]
        at += n
    begin, finish = np.array(begin, np.int64), np.array(finish, np.int64)
    wide = wordy[finish + 1] - wordy[begin] >= LEAST_LINES
    pairs = line_pairs(np.diff(wordy) > 0, per_text)
    # a pair that is a whole chunk comes once
    spans = np.unique(np.stack([np.concatenate([begin[wide], pairs[0]]), np.concatenate([finish[wide], pairs[1]])]), axis=1)
    begin, finish = spans
    owner = np.repeat(np.arange(len(per_text)), per_text)[begin]
    number = np.arange(len(begin)) - np.searchsorted(owner, owner)
    if bits is not None:
        some = known(bits, part.column("version").to_numpy()[owner], number)
        begin, finish, owner, number = begin[some], finish[some], owner[some], number[some]
    rows = pa.array(owner, pa.int64())
    hashed = tx.span_hash(data, starts[begin], ends[finish])
    more = [] if bits is None else [tx.span_texts(data, starts[begin], ends[finish])]
    return pa.RecordBatch.from_arrays(
        [
            part.column("id").take(rows),
            part.column("version").take(rows),
            pa.array(number, pa.int32()),
            pa.array(begin - (np.cumsum(per_text) - per_text)[owner], pa.int32()),
            pa.array(finish - begin + 1, pa.int32()),
            pa.array(hashed.view(np.int64)),
            *more,
        ],
        names=[c.split(" ")[0] for c in (HELD if more else CHUNKS).split(", ")],
    )


def chunk_rows(rows: DataFrame) -> DataFrame:
    """CHUNKS of (id, version, text): every chunk that could be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                yield chunk_batch(part)

    return rows.mapInArrow(run, CHUNKS)


def filter_of(chunks: DataFrame, n: int) -> np.ndarray:
    """The filter with both bits of each of the ``n`` rows (version, chunk) set, or'ed by Spark word by word."""
    size = 1 << min(max((BITS_A_CHUNK * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    at = [F.shiftrightunsigned("version", s).bitwiseXOR(F.col("chunk").cast("long")).bitwiseAND(F.lit(size - 1)) for s in FILTER_SHIFTS]
    places = chunks.select(F.explode(F.array(*at)).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def held_rows(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """HELD of (id, version, text): the chunks that the filter knows, with their bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                yield chunk_batch(part, shared.value)

    return rows.mapInArrow(run, HELD)


def disjoint(spans: list[dict]) -> list[dict]:
    """The lines of sorted spans as runs that share no line; a line counts for the first span that holds it."""
    runs: list[dict] = []
    end = 0
    for s in spans:
        begin, stop = max(s["first_line"], end), s["first_line"] + s["n_lines"]
        if begin >= stop:
            continue
        if runs and begin == end and runs[-1]["kept_id"] == s["kept_id"]:
            runs[-1]["n_lines"] += stop - begin
        else:
            runs.append({"first_line": begin, "n_lines": stop - begin, "kept_id": s["kept_id"]})
        end = stop
    return runs


def disjoint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed = batch.column("removed")
        runs = [disjoint(row.as_py()) for row in removed]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), pa.array(runs, removed.type)], names=["id", "version", "removed"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, removed): per text with repeats the sorted runs (first_line, n_lines, kept_id).

    Runs share no line; touching chunks with the same ``kept_id`` are one run.
    ``version`` is xxhash64 of the text, which tells rows of one id apart; rows equal in both are one
    text and share their spans. A null id comes before all others. Null texts, texts of one line
    and empty tables have no spans.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("version"), t.alias("text"))
    # rows of one id and text come more than once here; a chunk that only they repeat has one place and stays
    chunks = cut_lineage(chunk_rows(rows).select("version", "chunk", "hash"))
    again = chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    repeated = cut_lineage(chunks.join(again, "hash").select("version", "chunk"))
    held = cut_lineage(held_rows(rows, filter_of(repeated, repeated.count())))
    spot = F.struct("id", "version", "chunk")
    kept = held.groupBy(F.xxhash64("bytes").alias("h"), F.col("bytes").alias("b")).agg(F.min(spot).alias("kept"))
    later = held.join(kept, (F.xxhash64("bytes") == F.col("h")) & (F.col("bytes") == F.col("b"))).filter(~spot.eqNullSafe(F.col("kept")))
    span = F.struct("first_line", "n_lines", F.col("kept.id").alias("kept_id"))
    gone = later.groupBy("id", "version").agg(F.sort_array(F.collect_set(span)).alias("removed"))
    return gone.mapInArrow(disjoint_rows, SPANS)


def without_spans(text: Column, removed: Column) -> Column:
    """``text`` without the lines of the sorted spans ``removed``."""
    lines = F.split(text, "\n")
    begins = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["first_line"] + r["n_lines"]))
    ends = F.concat(F.transform(removed, lambda r: r["first_line"]), F.array(F.size(lines)))
    kept = F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.array_join(F.flatten(kept), "\n")


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", into: str | None = None
) -> DataFrame:
    """Every row of ``docs`` with its text freed of repeated chunks; its spans (or null) in ``into``.

    Columns keep their names and order; a null text stays null. The spans, a few numbers for each
    text with repeats, are broadcast if they are few and joined by a shuffle otherwise.
    """
    of, at, gone = tx.fresh_names(docs, "of", "at", "removed")
    spans = cut_lineage(repeated_spans(docs, id_col, text).select(F.col("id").alias(of), F.col("version").alias(at), F.col("removed").alias(gone)))
    few = (spans.agg(F.sum(F.size(gone))).first()[0] or 0) <= BROADCAST_SPANS
    t = docs[f"`{text}`"]
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(at))
    joined = docs.join(F.broadcast(spans) if few else spans, same, "left")
    clean = F.when(F.col(gone).isNull(), t).otherwise(without_spans(t, F.col(gone)))
    columns = [clean.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns]
    return joined.select(*columns, *([F.col(gone).alias(into)] if into else []))
