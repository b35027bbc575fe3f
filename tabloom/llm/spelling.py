"""Spelling variants of the corpus's words: near words, the form each is a variant of, and its root.

Letters are hashed to a few symbols. Every distinct reduced word sends the hashes of its full
one-edit neighbourhood (itself, each replaced, left out and inserted symbol), which are joined with
the reduced vocabulary; the words behind two reduced words that meet are compared on their original
letters. One edit of a word is one edit of its reduced word or none, so no pair is lost, and a pair
of reduced words is found from one of its sides only. Neighbourhoods are computed from prefix sums
of a polynomial hash, so a word of n letters costs n steps for each symbol however long it is.

The number of symbols follows the vocabulary (``symbol_count``): reduced words of the least length
stay about as many as the words, so groups of words behind one reduced word stay small. It changes
no result. Nothing is collected, and no group is a unit of work: words meet in plain joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SLIP_MODULUS = 31
LEAST_SYMBOLS = 4
CHUNK_LETTERS = 200_000
U = np.uint64
LENGTH_CODE = U(0xD6E8FEB86659FD93)


def slipped(run: Column, doc_id: Column) -> Column:
    """``run`` without one letter where crc32 of "<id>:<run>" is a multiple of 31; a null id is empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    n = F.length(run)
    at = (h % n).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, n))
    return F.when(h % SLIP_MODULUS == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) of all runs of letters of whole texts; null texts have none."""
    lowered = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run"))
    words = each.select(slipped(F.col("run"), F.col("id")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def symbol_count(n_words: int, least_length: int) -> int:
    """The fewest symbols whose words of the least length are as many as the vocabulary."""
    return max(LEAST_SYMBOLS, math.ceil(max(n_words, 1) ** (1 / max(least_length, 1))))


class Reduced:
    """The reduced forms of a list of words as one flat array of symbol codes."""

    def __init__(self, words: list[str], symbols: int) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
        self.codes = tx.mix(np.arange(1, symbols + 1, dtype=U) * tx.BASE) | U(1)
        self.symbol = (tx.mix(points + U(1)) % U(symbols)).astype(np.int64)
        self.length = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.up, self.down = tx.powers(len(points) + 2)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(points) + 1, U)
            np.cumsum(self.codes[self.symbol] * self.up[: len(points)], out=self.sums[1:])

    def finished(self, value: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tx.mix(value + length.astype(U) * LENGTH_CODE)

    def own(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[self.end] - self.sums[self.start]) * self.down[self.start]
        return self.finished(value, self.length)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the word, hash) of everything within one edit, each once."""
        words = np.arange(len(self.length))
        yield words, self.own()
        owner = np.repeat(words, self.length)
        s, e, n = self.start[owner], self.end[owner], self.length[owner]
        i = np.arange(len(owner))
        before = np.where(i > s, self.symbol[np.maximum(i - 1, 0)], -1) if len(i) else i
        with np.errstate(over="ignore"):
            head = (self.sums[i] - self.sums[s]) * self.down[s]
            tail = self.sums[e] - self.sums[i + 1]
            # of a run of equal symbols the first is left out
            once = before != self.symbol
            yield owner[once], self.finished(head + tail * self.down[s + 1], n - 1)[once]
            whole = (self.sums[e] - self.sums[s]) * self.down[s]
            rest = (self.sums[e] - self.sums[i]) * self.down[s]
            at_end = (self.sums[self.end] - self.sums[self.start]) * self.down[self.start]
            last = self.symbol[np.maximum(self.end - 1, 0)] if len(self.symbol) else self.length
            last = np.where(self.length > 0, last, -1)
            for c, code in enumerate(self.codes):
                other = self.symbol != c
                replaced = whole + (code - self.codes[self.symbol]) * self.up[i - s]
                yield owner[other], self.finished(replaced, n)[other]
                # a symbol goes in front of others, and behind a run of its own kind only
                fresh = before != c
                yield owner[fresh], self.finished(head + code * self.up[i - s] + rest * tx.BASE, n + 1)[fresh]
                fresh = last != c
                yield words[fresh], self.finished(at_end + code * self.up[self.length], self.length + 1)[fresh]


def by_letters(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """The words of a batch, about CHUNK_LETTERS letters at a time."""
    for part in tx.pieces(batch, "word", CHUNK_LETTERS):
        yield part.column("word").to_pylist()


def reduced_words(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, reduced) with the hash of each reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "word", CHUNK_LETTERS):
                own = Reduced(part.column("word").to_pylist(), symbols).own()
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(own.view(np.int64))], names=["word", "n", "reduced"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, reduced long")


def neighbour_hashes(words: DataFrame, symbols: int) -> DataFrame:
    """(reduced, near): the neighbourhood of each word's reduced form, hashes not below its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_letters(batch):
                reduced = Reduced(part, symbols)
                own = reduced.own()
                for word, near in reduced.neighbours():
                    keep = near >= own[word]
                    yield pa.RecordBatch.from_pydict({"reduced": own[word[keep]].view(np.int64), "near": near[keep].view(np.int64)})

    return words.select("word").mapInArrow(run, "reduced long, near long")


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """(a, b, n_a, n_b): every two of ``words`` (word, n) that differ by exactly one edit, once."""
    vocabulary = cut_lineage(reduced_words(words, symbols))
    forms = cut_lineage(vocabulary.groupBy("reduced").agg(F.min("word").alias("word")))
    meets = neighbour_hashes(forms, symbols).join(forms.select(F.col("reduced").alias("near")), "near")
    left = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "reduced")
    right = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("reduced").alias("near"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    in_order = (F.col("reduced") != F.col("near")) | (F.col("a") < F.col("b"))
    paired = cut_lineage(meets).join(left, "reduced").join(right, "near").where(in_order & one_edit)
    return paired.select("a", "b", "n_a", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form).

    Counts grow along a chain by FORM_RATIO, so chains are short and have no cycles; a round doubles the way.
    """
    way = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut_lineage(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return way


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
    symbols: int | None = None,
) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for every word with ``least_length`` letters and ``least_count`` uses.

    ``form`` is the near word of largest count (ties: smallest in code-point order) if that is ``ratio``
    times the word's own at least. Null and empty texts and empty tables give no words; repeated rows
    count again; a null id is an empty one; words of any length are compared whole. Other columns of
    ``docs`` are not read, whatever their names.
    """
    words = cut_lineage(word_counts(docs, id_col, text, least_length).where(F.col("n") >= least_count))
    pairs = cut_lineage(near_words(words, symbols or symbol_count(words.count(), least_length)))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    sides = sides.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    found = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= ratio * F.col("n")
    judged = cut_lineage(
        words.join(found, "word", "left").select(
            "word",
            "n",
            F.when(strong, F.col("best.other")).alias("form"),
            F.when(strong, -F.col("best.m")).alias("form_n"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
