"""Phrases whose words stand together more often than their parts explain, per language.

Every n-gram of one to five words that occurs often enough is found in two passes. The first keeps
Misra-Gries summaries: n-grams fall by their hash into partitions, and a partition's summaries, in
tasks and where they are merged, hold more counters than its mass (n-gram occurrences) divided by
the threshold. What a summary takes off a counter is added up, so a count plus all that was taken
off in its partition is never below the true one and every frequent n-gram survives. The second
pass counts the survivors exactly, by their words. The first pass goes in steps (words, pairs of
surviving words, three to five words of surviving pairs), as no n-gram is more frequent than its parts.

Survivors go to the second pass as a bitmap of their hashes with a bounded number of bits: a wrong
hit costs time, as only exact counts decide. Nothing else is broadcast or collected but the masses of
the partitions. Hot n-grams and languages are summed inside tasks before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage, shuffle_width

LEAST = 100
LONGEST = 5
TOP = 2000
NO_LANG = "und"
STEPS = ((1,), (2,), (3, 4, 5))
SLOT_BITS = 12
SUMMARY_ROWS = 4_000_000  # n-grams of a task that one summary takes in
MERGE_ROWS = 1_000_000  # counters of the partitions that one task merges
BITS_PER_KEY = 32
MOST_BITS = 29  # a bitmap of 64 MB at most
HELD_PHRASES = 200_000  # new rows of a task's table of phrases before they are summed into it
MOST_HELD = 2_000_000  # rows of that table, some 100 MB
PARTS = 64
U = np.uint64
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True


class Words:
    """The words of a slice of (lang, text) with their hashes, pieces and languages."""

    def __init__(self, part: pa.RecordBatch) -> None:
        data, offsets = tx.flat(part.column("text"))
        self.data = tx.LOWER[data]
        self.start, self.end, counts = tx.word_spans(self.data, offsets, APART)
        self.hash = tx.span_hash(self.data, self.start, self.end)
        owner = np.repeat(np.arange(len(counts)), counts)
        broken = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[self.data], out=broken[1:])
        self.piece = broken[self.start] + owner
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[owner]
        codes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.sums = [np.array(codes or [0], U)[self.lang]]
        with np.errstate(over="ignore"):
            for j in range(LONGEST):
                step = tx.mix(self.hash[j:] + tx.PLACE_CODE[j])
                self.sums.append(self.sums[-1][: len(step)] + step)

    def keys(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of ``width`` words and whether each lies within one piece."""
        n = max(len(self.hash) - width + 1, 0)
        whole = self.piece[:n] == self.piece[width - 1 : width - 1 + n]
        with np.errstate(over="ignore"):
            return tx.mix(self.sums[width][:n] + U(width) * tx.BASE), whole

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with one space behind each, and where each begins and ends there."""
        size = self.end - self.start + 1
        stop = np.cumsum(size)
        at = np.repeat(self.start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        out = self.data[np.minimum(at, max(len(self.data) - 1, 0))]
        out[stop - 1] = 0x20
        return out, stop - size, stop - 1


class Bitmap:
    """A set of hashes, one bit for the highest bits of each; may hold others besides."""

    def __init__(self, bits: int, rows: Sequence[tuple[int, bytes]]) -> None:
        self.shift = U(64 - bits)
        self.held = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
        for bucket, piece in rows:
            at = (bucket - 1) * 4096
            part = np.frombuffer(piece, np.uint8)
            self.held[at : at + len(part)] = part[: len(self.held) - at]

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.held[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame) -> Bitmap:
    """The bitmap of a written table of hashes; its size follows their number up to MOST_BITS."""
    bits = min(MOST_BITS, max(15, (max(keys.count(), 1) * BITS_PER_KEY - 1).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits) + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("piece"))
    return Bitmap(bits, [(r["bucket"], bytes(r["piece"])) for r in pieces.collect()])


def held_keys(words: Words, width: int, maps: Sequence[Bitmap]) -> np.ndarray:
    """Hashes of the n-grams that may be frequent, judged by the words or pairs that they hold."""
    keys, whole = words.keys(width)
    if not maps:
        return keys[whole]
    inner = 1 if len(maps) == 1 else 2
    parts = maps[-1].has(words.keys(inner)[0])
    for j in range(width - inner + 1):
        whole = whole & parts[j : j + len(whole)]
    return keys[whole]


def cut_to(keys: np.ndarray, counts: np.ndarray, capacity: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted counters with no partition above its capacity; ``lost`` grows by what its counters lose."""
    slot = (keys >> U(64 - SLOT_BITS)).astype(np.int64)
    size = np.bincount(slot, minlength=len(capacity))
    over = np.flatnonzero(size > capacity)
    if not len(over):
        return keys, counts
    first = np.cumsum(size) - size
    counts = counts.copy()
    for s in over.tolist():
        own = counts[first[s] : first[s] + size[s]]
        off = np.partition(own, size[s] - capacity[s] - 1)[size[s] - capacity[s] - 1]
        own -= off
        lost[s] += off
    return keys[counts > 0], counts[counts > 0]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def counter_rows(keys: np.ndarray, counts: np.ndarray, lost: np.ndarray) -> pa.RecordBatch:
    """(key, n); what a partition's counters lost comes as a negative number at its lowest hash."""
    less = np.flatnonzero(lost)
    key = np.concatenate([keys, less.astype(U) << U(64 - SLOT_BITS)])
    return pa.RecordBatch.from_pydict({"key": key.view(np.int64), "n": np.concatenate([counts, -lost[less]]).astype(np.int64)})


def survivors(rows: DataFrame, widths: Sequence[int], maps: Sequence[Bitmap], mass: np.ndarray, least: int) -> DataFrame:
    """(key): hashes of n-grams of ``widths``, all that occur ``least`` times among them."""
    capacity = mass // least + 1
    shared = rows.sparkSession.sparkContext.broadcast(list(maps))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            lost = np.zeros(len(capacity), np.int64)
            return counter_rows(*cut_to(keys, counts, capacity, lost), lost)

        for batch in batches:
            for part in tx.pieces(batch, "text"):
                words = Words(part)
                for width in widths:
                    held.append(held_keys(words, width, shared.value))
                    total += len(held[-1])
                if total >= SUMMARY_ROWS:
                    yield out()
                    held, total = [], 0
        if total:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        lost = np.zeros(len(capacity), np.int64)
        held, total = [], 0

        def taken_in() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([keys, *[h[0] for h in held]])
            n = np.concatenate([counts, *[h[1] for h in held]])
            return cut_to(*summed(key, n), capacity, lost)

        for batch in batches:
            key, n = batch.column("key").to_numpy().view(U), batch.column("n").to_numpy()
            np.add.at(lost, (key[n < 0] >> U(64 - SLOT_BITS)).astype(np.int64), -n[n < 0])
            held.append((key[n > 0], n[n > 0]))
            total += len(key)
            if total >= MERGE_ROWS:
                keys, counts = taken_in()
                held, total = [], 0
        keys, counts = taken_in()
        slot = (keys >> U(64 - SLOT_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"key": keys[counts + lost[slot] >= least].view(np.int64)})

    width = max(shuffle_width(rows.sparkSession), -(-int(capacity.sum()) // MERGE_ROWS))
    counters = rows.mapInArrow(summarise, "key long, n long").repartition(width, F.shiftrightunsigned("key", 64 - SLOT_BITS))
    return cut_lineage(counters.mapInArrow(merge, "key long"))


def masses(rows: DataFrame) -> DataFrame:
    """(step, slot, lang, n): n-gram occurrences by step and partition, and words by language (step -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(STEPS), 1 << SLOT_BITS), np.int64)
        langs: dict[str, int] = {}
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                words = Words(part)
                for step, widths in enumerate(STEPS):
                    for width in widths:
                        keys, whole = words.keys(width)
                        total[step] += np.bincount((keys[whole] >> U(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
                own = np.bincount(words.lang, minlength=len(words.langs)).tolist()
                for lang, n in zip(words.langs, own, strict=True):
                    langs[lang] = langs.get(lang, 0) + n
        step, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([step, np.full(len(langs), -1)]), pa.int32()),
                pa.array(np.concatenate([slot, np.zeros(len(langs), np.int64)]), pa.int32()),
                pa.array([""] * len(step) + list(langs), pa.string()),
                pa.array(np.concatenate([total[step, slot], np.array(list(langs.values()), np.int64)]), pa.int64()),
            ],
            names=["step", "slot", "lang", "n"],
        )

    parts = rows.mapInArrow(run, "step int, slot int, lang string, n long")
    return cut_lineage(parts.groupBy("step", "slot", "lang").agg(F.sum("n").alias("n")))


class Counted:
    """Phrases by hash with their counts, texts and languages: batches gathered, then summed into one sorted table."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
        self.fresh = self.size = 0

    def add(self, words: Words, maps: Sequence[Bitmap]) -> None:
        keys, starts, ends, at = [], [], [], []
        data, start, end = words.spaced()
        for step, widths in enumerate(STEPS):
            for width in widths:
                own, whole = words.keys(width)
                i = np.flatnonzero(whole & maps[step].has(own))
                keys.append(own[i])
                starts.append(start[i])
                ends.append(end[i + width - 1])
                at.append(i)
        keys, first, counts = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        texts = tx.span_texts(data, np.concatenate(starts)[first], np.concatenate(ends)[first])
        langs = pa.array(words.langs, pa.string()).take(pa.array(words.lang[np.concatenate(at)[first]]))
        self.parts.append((keys, counts, texts, langs))
        self.fresh += len(keys)
        if self.fresh >= max(HELD_PHRASES, self.size):
            self.sum_up()

    def sum_up(self) -> None:
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        first = pa.array(order[starts])
        texts, langs = (pa.concat_arrays([p[i] for p in self.parts]).take(first) for i in (2, 3))
        self.parts = [(keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts, texts, langs)]
        self.fresh, self.size = 0, len(starts)

    def out(self) -> pa.RecordBatch:
        self.sum_up()
        _, counts, texts, langs = self.parts[0]
        self.__init__()
        return pa.RecordBatch.from_arrays([langs, texts, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "n"])


def phrase_counts(rows: DataFrame, maps: Sequence[Bitmap], least: int) -> DataFrame:
    """(lang, phrase, f) of every n-gram of one to five words that occurs ``least`` times."""
    shared = rows.sparkSession.sparkContext.broadcast(list(maps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                held.add(Words(part), shared.value)
                if held.size >= MOST_HELD:
                    yield held.out()
        if held.parts:
            yield held.out()

    partial = rows.mapInArrow(run, "lang string, phrase string, n long")
    return partial.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Written (lang, phrase, f, words) of the frequent n-grams, and (lang, n) with all words of a language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    mass = masses(rows)
    by_slot = np.zeros((len(STEPS), 1 << SLOT_BITS), np.int64)
    for r in mass.where("step >= 0").collect():  # at most 3 x 4096 numbers
        by_slot[r["step"], r["slot"]] = r["n"]
    maps: list[Bitmap] = []
    for step, widths in enumerate(STEPS):
        maps.append(bitmap_of(survivors(rows, widths, maps, by_slot[step], least)))
    found = cut_lineage(phrase_counts(rows, maps, least)).withColumn("words", F.split("phrase", " "))
    return found, mass.where("step < 0").select("lang", "n")


def joined(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut."""
    phrases = found.where(F.size("words") > 1)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    words, k = F.col("words"), F.col("k")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(words, F.lit(1), k).alias("left"), joined(words, k + 1, F.size(words)).alias("right"))
    part = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cuts = cuts.join(part, ["lang", "left"])
    cuts = cuts.join(part.withColumnsRenamed({"left": "right", "l": "r"}), ["lang", "right"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("up", wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).withColumn("down", wide["l"] * wide["r"])
    best = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def inside_longer(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase that holds the phrase's words in a row."""
    longer = found.where(F.size("words") > 2)
    size = F.size("words")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: joined(F.col("words"), i, n)),
        )
    )
    return longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to five words.

    A phrase inside a longer one that occurs as often is left out. Null texts count as empty, a null lang is
    "und"; empty texts and tables give no rows; repeated rows count again; ties of score and count fall to
    the phrase in byte order. Texts of any length are read whole, a piece of work at a time. Other
    columns are not read, whatever their names.
    """
    found, totals = frequent_phrases(docs, text, lang, least)
    own = scored(found, totals).join(inside_longer(found), ["lang", "phrase"], "left")
    left = own.where(F.coalesce(F.col("most") < F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part, then of the language
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    few = left.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
