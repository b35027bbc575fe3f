"""Packing of tokenised documents into sequences of bounded length.

The plan needs no documents, only the counts of the piece lengths, at most one per length. It
follows the linear grouping scheme: pieces above an eighth of the capacity are sorted by length, cut
into groups of equal cardinality and rounded up to the longest of their group. For these few sizes
configurations are optimised one after another: each takes the largest size left and the set of
sizes that fills its sequence best, as often as its sizes last. Then the real lengths take the
places of the rounded ones, and the room this leaves is filled with the small pieces, best fit in
falling length. Runs of like sequences are one entry of the plan throughout, so its size depends on
the lengths and not on the number of documents. Spark numbers the pieces of every length, and each
piece finds its sequence and place by its number.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

CAPACITY = 2048
GROUPS = 512
BUCKET_ROWS = 200_000
END_TEXT = "<|endoftext|>"
END_ID = 50256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(ranks: str):
    """The byte-level tokenizer of a rank file; the end-of-text mark in a text is its special token."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={END_TEXT: END_ID})


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones of ``capacity`` behind a first, maybe shorter one."""
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n_tokens, capacity)]


def token_pieces(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of (doc_id, text): the text's ids and a closing 0. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
                    raw = np.append(ids, 0).astype("<u4").tobytes()
                    for p, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        out.append((doc, p, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                    names=[c.split(" ")[0] for c in PIECES.split(", ")],
                )

    return docs.mapInArrow(run, PIECES)


@dataclass
class Run:
    """``count`` sequences alike: slot (length, number) holds pieces number, number + 1, ... of a length."""

    room: int
    count: int
    slots: list[tuple[int, int]] = field(default_factory=list)

    def split(self, at: int) -> tuple[Run, Run]:
        return (
            Run(self.room, at, list(self.slots)),
            Run(self.room, self.count - at, [(length, number + at) for length, number in self.slots]),
        )


def grouped(counts: Mapping[int, int], groups: int) -> list[list[list[int]]]:
    """Groups of equal cardinality in falling length, each a list of [length, count, first number]."""
    size = -(-sum(counts.values()) // groups) if counts else 1
    out: list[list[list[int]]] = [[]]
    space = size
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            if not space:
                out.append([])
                space = size
            take = min(left, space)
            out[-1].append([length, take, number])
            left, number, space = left - take, number + take, space - take
    return [g for g in out if g]


def best_filled(sizes: list[int], left: list[int], first: int, capacity: int) -> dict[int, int]:
    """How often each size is used beside ``first`` so that the sum comes closest to ``capacity``."""
    room = capacity - sizes[first]
    came = np.full(room + 1, -1, np.int32)  # the size that first reached a sum
    came[0] = len(sizes)
    top = 0
    for i in range(len(sizes)):
        uses = left[i] - (i == first)
        for _ in range(min(uses, room // sizes[i])):
            if sizes[i] > room:
                break
            fresh = (came[: room + 1 - sizes[i]] >= 0) & (came[sizes[i] :] < 0)
            if not fresh.any():
                break
            came[sizes[i] :][fresh] = i
        top = int(np.flatnonzero(came >= 0)[-1])
        if top == room:
            break
    pattern = {first: 1}
    while top:
        i = int(came[top])
        pattern[i] = pattern.get(i, 0) + 1
        top -= sizes[i]
    return pattern


def large_runs(counts: Mapping[int, int], capacity: int, groups: int) -> list[Run]:
    """Sequences for the large pieces: configurations of the group sizes, real pieces put in."""
    pools = grouped(counts, groups)
    sizes = [g[0][0] for g in pools]
    left = [sum(p[1] for p in g) for g in pools]
    runs: list[Run] = []

    def take(i: int, count: int) -> list[list[int]]:
        """The next ``count`` real pieces of group ``i`` as [length, count, number]."""
        got = []
        while count:
            head = pools[i][0]
            n = min(count, head[1])
            got.append([head[0], n, head[2]])
            head[1], head[2], count = head[1] - n, head[2] + n, count - n
            if not head[1]:
                pools[i].pop(0)
        return got

    for first in range(len(sizes)):
        while left[first]:
            pattern = best_filled(sizes, left, first, capacity)
            times = min(left[i] // n for i, n in pattern.items())
            fresh = [Run(capacity, times)]
            for i, n in pattern.items():
                left[i] -= n * times
                for _ in range(n):
                    filled: list[Run] = []
                    for length, count, number in take(i, times):
                        while count:
                            run = fresh.pop(0)
                            if run.count > count:
                                run, rest = run.split(count)
                                fresh.insert(0, rest)
                            filled.append(Run(run.room - length, run.count, [*run.slots, (length, number)]))
                            number, count = number + run.count, count - run.count
                    fresh = filled
            runs += fresh
    return runs


def fill_small(runs: list[Run], counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Best fit in falling length: always into the sequence whose room fits closest."""
    by_room: dict[int, list[Run]] = {}
    for run in runs:
        by_room.setdefault(run.room, []).append(run)

    def put(run: Run, times: int, length: int, number: int) -> None:
        """``times`` pieces of ``length`` into every sequence of the run."""
        slots = [(length, number + j * run.count) for j in range(times)]
        by_room.setdefault(run.room - times * length, []).append(Run(0, run.count, run.slots + slots))

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        fits = iter(sorted(r for r in by_room if r >= length))
        room = next(fits, None)
        while left:
            if room is None:
                by_room.setdefault(capacity, []).append(Run(capacity, -(-left // (capacity // length))))
                room, fits = capacity, iter(())
            if not by_room.get(room):
                by_room.pop(room, None)
                room = next(fits, None)
                continue
            run = by_room[room].pop()
            run.room = room
            each = min(room // length, left)
            whole = min(run.count, left // each)
            if whole < run.count:
                run, rest = run.split(whole)
                by_room[room].append(rest)
            put(run, each, length, number)
            left, number = left - whole * each, number + whole * each
    return [Run(room, r.count, r.slots) for room, rows in by_room.items() for r in rows if r.slots]


def plan(counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first number, last number, first sequence, offset), sorted."""
    whole = [Run(0, counts[capacity], [(capacity, 0)])] if counts.get(capacity) else []
    large = {n: c for n, c in counts.items() if capacity // 8 < n < capacity}
    small = {n: c for n, c in counts.items() if n <= capacity // 8}
    out, sequence = [], 0
    for run in whole + fill_small(large_runs(large, capacity, groups), small, capacity):
        offset = 0
        for length, number in run.slots:
            out.append((length, number, number + run.count - 1, sequence, offset))
            offset += length
        sequence += run.count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``number``, counted from 0 within each length, by hash buckets of bounded size."""
    width = max(1, -(-pieces.count() // BUCKET_ROWS))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(width)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("place")).drop("bucket", "base", "place")


def pack(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece: PIECES with sequence_id and offset.

    Every row of ``docs`` is packed: null texts and empty ones are the closing id alone, rows that
    repeat an id are packed one by one, null ids stay null, other columns are not read. An empty
    table gives no rows. Texts are tokenised once; the pieces, a few numbers each, are written.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = cut_lineage(token_pieces(named, ranks, capacity))
    lengths = pieces.groupBy("length").count().collect()  # at most one row per length up to the capacity
    table = plan({r["length"]: r["count"] for r in lengths}, capacity, groups)
    codes = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(codes, (length << 48) + number, "right") - 1
            columns = [batch.column(c) for c in names[:5]]
            sequence = pa.array(table[at, 3] + number - table[at, 1])
            yield pa.RecordBatch.from_arrays([*columns, sequence, pa.array(table[at, 4])], names=names)

    schema = PIECES + ", sequence_id long, offset long"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return numbered(pieces).mapInArrow(place, schema).withColumnRenamed("doc_id", id_col)
