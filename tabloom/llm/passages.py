"""Passages that the corpus repeats word for word or nearly so, wherever they stand in their texts.

Texts are cut into segments by content: a segment begins at a word whose hash over itself and its two
neighbours is the smallest within RADIUS words on both sides, whatever lines, blanks or sentences do.
A passage of 51 words holds a whole segment of eight words or more with probability 0.98, more words almost
surely. Such segments are paragraphs without a choice of bands: equal ones are one node. The first in the
order of id, text hash and place stands for it, and each other is an anchor: anchors of one text that
meet one other text at the same distance form a run, and a run is extended word by word at both ends. It
is a repeated passage if it has LEAST_PASSAGE words and its words are equal to the other's throughout, or
three quarters of them lie in anchors, so that replacing the others turns one into the other.

Only hashes of words travel: of all segments a key, of the ends of runs 64 words on each side. Hot
segments are counted inside tasks first, and joins on them are plain ones that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage

RADIUS = 5
LEAST_SEGMENT = 8
LEAST_PASSAGE = 50
MOST_GAP = LEAST_SEGMENT - 1  # one short segment
REACH = 64
PERCENT = 75
SLICE_BYTES = 1 << 18
BROADCAST_BYTES = 64 << 20
U = np.uint64


def run_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [start, end) of an array of word hashes."""
    up, down = tx.powers(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(tx.mix(words + tx.PLACE_CODE[5]) * up[: len(words)], out=sums[1:])
        return tx.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def segments(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every segment of the texts with ``counts`` words each."""
    n = len(words)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[owner]
    cut = (place >= RADIUS + 1) & (place < counts[owner] - RADIUS - 1)
    near = np.concatenate([np.zeros(1, U), words, np.zeros(1, U)])
    with np.errstate(over="ignore"):
        value = tx.mix(near[:-2] * tx.PLACE_CODE[1] + near[1:-1] * tx.PLACE_CODE[2] + near[2:] * tx.PLACE_CODE[3])
    for k in range(1, RADIUS + 1):
        cut[k:] &= value[k:] < value[:-k]
        cut[:-k] &= value[:-k] <= value[k:]
    cut[first[counts > 0]] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n)


def segment_rows(rows: DataFrame) -> DataFrame:
    """(id, version, at, n, key) of the segments of LEAST_SEGMENT words or more of (id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                words, counts = tx.word_hashes(part.column("text"))
                if not len(words):
                    continue
                start, end = segments(words, counts)
                long = end - start >= LEAST_SEGMENT
                start, end = start[long], end[long]
                first = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)[start]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(at),
                        part.column("version").take(at),
                        pa.array((start - first[owner]).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)),
                        pa.array(run_hash(words, start, end).view(np.int64)),
                    ],
                    names=["id", "version", "at", "n", "key"],
                )

    return rows.mapInArrow(run, "id long, version long, at int, n int, key long")


def anchored_runs(rows: DataFrame) -> DataFrame:
    """(id, version, at, n, covered, rid, rversion, rat): runs of segments that an earlier place holds too."""
    found = cut_lineage(segment_rows(rows))
    again = cut_lineage(found.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("key"))
    # a key takes some 50 bytes in a broadcast
    same = cut_lineage(found.join(F.broadcast(again) if 50 * again.count() <= BROADCAST_BYTES else again, "key", "left_semi"))
    spot = F.struct("id", "version", "at")
    firsts = same.groupBy("key").agg(F.min(spot).alias("rep"))
    later = same.join(firsts, "key").where(~spot.eqNullSafe(F.col("rep")))
    anchors = later.select("id", "version", "at", "n", F.col("rep.id").alias("rid"), F.col("rep.version").alias("rversion"), (F.col("at") - F.col("rep.at")).alias("shift"))
    one = ["id", "version", "rid", "rversion", "shift"]
    before = Window.partitionBy(*one).orderBy("at")
    fresh = F.col("at") > F.lag(F.col("at") + F.col("n")).over(before) + MOST_GAP
    islands = anchors.distinct().withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(before))
    runs = islands.groupBy(*one, "island").agg(
        F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n"), F.sum("n").cast("int").alias("covered")
    )
    return cut_lineage(runs.select("id", "version", "at", "n", "covered", "rid", "rversion", (F.col("at") - F.col("shift")).alias("rat")))


def surroundings(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, version, at, n, whole, left, right): a hash of the words of each run of both sides, and the hashes around it."""
    own = runs.select("id", "version", "at", "n")
    wanted = own.union(runs.select("rid", "rversion", "rat", "n")).distinct()
    grouped = cut_lineage(wanted.groupBy(F.col("id").alias("of"), F.col("version").alias("by")).agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    size = grouped.agg(F.sum(F.size("runs") * 16 + 64)).first()[0] or 0
    asked = rows.join(F.broadcast(grouped) if size <= BROADCAST_BYTES else grouped, F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("by"))).select("id", "version", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                words, counts = tx.word_hashes(part.column("text"))
                first = np.cumsum(counts) - counts
                lists = part.column("runs").to_pylist()
                owner = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                at = np.array([r["at"] for x in lists for r in x], np.int64)
                n = np.array([r["n"] for x in lists for r in x], np.int64)
                start = first[owner] + at
                whole = run_hash(words, start, start + n)
                small = (words >> U(32)).astype(np.uint32)
                low, high = first[owner], (first + counts)[owner]
                left = [small[max(a, s - REACH) : s][::-1].tobytes() for s, a in zip(start.tolist(), low.tolist(), strict=True)]
                right = [small[e : min(b, e + REACH)].tobytes() for e, b in zip((start + n).tolist(), high.tolist(), strict=True)]
                which = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(which), part.column("version").take(which), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(whole.view(np.int64)), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                    ],
                    names=["id", "version", "at", "n", "whole", "left", "right"],
                )

    schema = "id long, version long, at int, n int, whole long, left binary, right binary"
    # rows equal in id and text give the same surroundings
    return cut_lineage(asked.mapInArrow(run, schema).dropDuplicates(["id", "version", "at", "n"]))


def shared_length(a: bytes, b: bytes) -> int:
    """How many leading 32-bit numbers two byte strings share."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n))
    return int(differ[0]) if len(differ) else n


def repeated_passages(rows: DataFrame, least: int = LEAST_PASSAGE, percent: int = PERCENT) -> DataFrame:
    """(id, version, first_word, n_words, kept_id) of every later copy of a passage in (id, version, text).

    A null id comes before all others; rows equal in id and text are one text. Texts without a repeated
    passage and empty tables give no rows.
    """
    runs = anchored_runs(rows)
    around = surroundings(rows, runs)
    side = lambda tag: around.select(*[F.col(c).alias(f"{tag}_{c}") for c in around.columns])

    def at(tag: str, *cols: str) -> Column:
        a, b, c, d = (f"{tag}_{x}" for x in ("id", "version", "at", "n"))
        return F.col(cols[0]).eqNullSafe(F.col(a)) & (F.col(cols[1]) == F.col(b)) & (F.col(cols[2]) == F.col(c)) & (F.col("n") == F.col(d))

    both = runs.join(side("o"), at("o", "id", "version", "at")).join(side("r"), at("r", "rid", "rversion", "rat"))
    same = (F.col("o_whole") == F.col("r_whole")) | (100 * F.col("covered") >= percent * F.col("n"))
    meets = both.where(same).select("id", "version", "at", "n", "rid", "o_left", "r_left", "o_right", "r_right")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(c).to_pylist() for c in ("o_left", "r_left", "o_right", "r_right")]
            before = np.array([shared_length(a, b) for a, b in zip(ends[0], ends[1], strict=True)], np.int32)
            behind = np.array([shared_length(a, b) for a, b in zip(ends[2], ends[3], strict=True)], np.int32)
            first = batch.column("at").to_numpy() - before
            n = batch.column("n").to_numpy() + before + behind
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("version"), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), batch.column("rid")],
                names=["id", "version", "first_word", "n_words", "kept_id"],
            )

    found = meets.mapInArrow(extend, "id long, version long, first_word int, n_words int, kept_id long")
    return cut_lineage(found.where(F.col("n_words") >= least).distinct())
