"""Removal of paragraphs that the corpus repeats, copied or slightly edited.

A paragraph is a line ("\\n") of at least 20 words. Its set holds its five-word shingles (A-Z
lower-cased). MinHash bands bring similar paragraphs together; ``tuned`` picks the fewest bands of
the given width that find a pair at the threshold with the wanted probability. Paragraphs that
collide in a band are verified by the exact Jaccard similarity of their sets, and verified links are
closed to components. In the order of id, text hash and place the first paragraph of a component
stays and all others go.

Passages of 50 words or more that begin and end anywhere are found by ``passages`` and go as well, from the
second place on: what a line does not delimit is a paragraph too.

Paragraphs with equal sets are one node from the start, so copies send their bands once for each
task, and every text is read by its first place only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.llm.fingerprint import FACTOR, SHIFT
from tabloom.llm.line_chunks import line_spans
from tabloom.llm.links import BROADCAST_IDS, closed_links, components, paired_texts, similar, sketch
from tabloom.llm.ngram_join import set_key
from tabloom.llm.passages import repeated_passages
from tabloom.session import cut_lineage

WIDTH = 5
PERCENT = 75
LEAST_WORDS = 20
BAND_WIDTH = 4
RECALL = 0.997
BUCKETS = 256
BROADCAST_BYTES = 16 << 20
SLICE_BYTES = 1 << 18  # of text at a time, for small workers
SPAN = "struct<first_word:int,n_words:int>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
U = np.uint64


def tuned(percent: int = PERCENT, width: int = BAND_WIDTH, recall: float = RECALL) -> int:
    """The fewest bands of ``width`` minima that a pair of similarity ``percent`` meets with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** width))


def paragraph_sets(part: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and line of each paragraph of the batch, where its set begins and all sets, sorted, one behind the other."""
    data, offsets = tx.flat(part.column("text"))
    data = tx.LOWER[data]
    starts, ends, per_text = line_spans(data, offsets)
    # lines as texts of their own: each ends before its break
    word_start, word_end, _ = tx.word_spans(data, offsets)
    hashes = tx.span_hash(data, word_start, word_end)
    low, high = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    line = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    wanted = np.flatnonzero(high - low >= least)
    counts = (high - low)[wanted]
    first = np.cumsum(counts) - counts
    words = hashes[np.repeat(low[wanted] - first, counts) + np.arange(counts.sum())]
    values, sizes = tx.shingles(words, counts, WIDTH)
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    once = np.ones(len(values), bool)
    once[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[once], of[once]
    return owner[wanted], line[wanted], np.searchsorted(of, np.arange(len(wanted))), values


def set_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key (as ``set_key`` gives it) and the size of each set."""
    sizes = np.diff(np.append(starts, len(values)))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(tx.mix(values + tx.BASE), starts) if len(starts) else np.zeros(0, U)
        return tx.mix(sums + sizes.astype(U)).view(np.int64), sizes


def sketches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int) -> list[bytes]:
    """A ``sketch`` of each set, those of the least width all at once."""
    small = sizes < buckets
    place = np.cumsum(small) - 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = small[of]
    cell = place[of[inside]] * buckets + (values[inside] & U(buckets - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(small.sum()) * buckets) & 1).astype(np.uint8).reshape(-1, buckets)
    rows = np.packbits(odd, axis=1, bitorder="little")
    return [
        rows[p].tobytes() if s else sketch(values[a : a + n], buckets)
        for s, p, a, n in zip(small.tolist(), place.tolist(), starts.tolist(), sizes.tolist(), strict=True)
    ]


def occurrences(rows: DataFrame, least: int) -> DataFrame:
    """(id, version, line, node, n, sketch) of every paragraph of (id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                row, line, starts, values = paragraph_sets(part, least)
                nodes, sizes = set_keys(values, starts)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(at),
                        part.column("version").take(at),
                        pa.array(line.astype(np.int32)),
                        pa.array(nodes),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sketches(values, starts, sizes, BUCKETS), pa.binary()),
                    ],
                    names=["id", "version", "line", "node", "n", "sketch"],
                )

    return rows.mapInArrow(run, "id long, version long, line int, node long, n long, sketch binary")


def band_rows(rows: DataFrame, least: int, bands: int, width: int) -> DataFrame:
    """(sig, node) for each band; a set that a task has met before is not sent again."""
    draws = bands * width
    scale = FACTOR[:draws] if draws <= len(FACTOR) else tx.mix(np.arange(1, draws + 1, dtype=U)) | U(1)
    shift = SHIFT[:draws] if draws <= len(SHIFT) else tx.mix(np.arange(1, draws + 1, dtype=U) + tx.BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                _, _, starts, values = paragraph_sets(part, least)
                nodes, sizes = set_keys(values, starts)
                new = np.zeros(len(nodes), bool)
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new[i] = True
                if not new.any():
                    continue
                flat, nodes, sizes = values[np.repeat(new, sizes)], nodes[new], sizes[new]
                starts = np.cumsum(sizes) - sizes
                low = np.empty((draws, len(nodes)), U)
                with np.errstate(over="ignore"):
                    for p in range(draws):
                        low[p] = np.minimum.reduceat(flat * scale[p] + shift[p], starts)
                    grouped = tx.mix(low.T.reshape(len(nodes), bands, width) + tx.PLACE_CODE[:width])
                    sig = tx.mix(grouped.sum(axis=2, dtype=U) + np.arange(bands, dtype=U) * tx.BASE)
                yield pa.RecordBatch.from_pydict({"sig": sig.reshape(-1).view(np.int64), "node": np.repeat(nodes, bands)})

    return rows.mapInArrow(run, "sig long, node long")


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    recall: float = RECALL,
) -> DataFrame:
    """One row for each paragraph that has a like: (id, version, line, cluster, kept_id, members, removed).

    ``version`` (xxhash64 of the text) tells rows of one id apart; rows equal in both are one text.
    ``kept_id`` is the id of the cluster's first paragraph, which alone has ``removed`` false;
    ``members`` counts the cluster's paragraphs. A null id comes before all others. Null texts, texts
    without long lines and empty tables give no rows.
    """
    rows = text_rows(docs, id_col, text)
    found = cut_lineage(occurrences(rows, least_words))
    placed = found.select("id", "version", "line", "node").distinct()
    spot = F.struct("id", "version", "line")
    places = cut_lineage(placed.groupBy("node").agg(F.min(spot).alias("spot"), F.count(F.lit(1)).alias("members")))
    sets = cut_lineage(found.groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")))

    group = Window.partitionBy("sig")
    numbered = band_rows(rows, least_words, tuned(percent, BAND_WIDTH, recall), BAND_WIDTH).select(
        "sig",
        "node",
        F.row_number().over(group.orderBy("node")).alias("rn"),
        F.min("node").over(group).alias("low"),
        F.max("node").over(group).alias("top"),
        F.count(F.lit(1)).over(group).alias("count"),
    )
    multi = cut_lineage(numbered.filter("low < top").drop("low", "top"))

    def fetch(nodes: DataFrame) -> DataFrame:
        at = cut_lineage(nodes.join(places, "node").select("node", F.col("spot.id").alias("of"), F.col("spot.version").alias("at"), "spot.line"))
        few = at.count() <= BROADCAST_IDS
        same = F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("at"))
        found = rows.join(F.broadcast(at) if few else at, same)
        return found.select("node", F.get(F.split("text", "\n"), "line").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(paired_texts(pairs, fetch), WIDTH, percent, set_key)

    edges = closed_links(multi, sets, verify, percent)
    label = components(edges)
    clustered = cut_lineage(places.join(label, "node", "left").select("node", "spot", "members", F.coalesce("label", "node").alias("cluster")))
    whole = clustered.groupBy("cluster").agg(F.min("spot").alias("kept"), F.sum("members").alias("members")).filter("members > 1")
    by_node = clustered.select("node", "cluster").join(whole, "cluster")
    return placed.join(by_node, "node").select(
        "id", "version", "line", "cluster", F.col("kept.id").alias("kept_id"), "members", (~spot.eqNullSafe(F.col("kept"))).alias("removed")
    )


def text_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("version"), t.alias("text"))


def without_repeats(text: str, lines: list[int], spans: list[tuple[int, int]]) -> str:
    """``text`` without the given lines and without the words (first, how many) of ``spans``.

    A line that loses its last word goes as well.
    """
    words = [m.span() for m in WORD.finditer(text)] if spans else []
    holes = sorted((words[a][0], words[a + n - 1][1]) for a, n in spans)
    kept, at, gone = [], 0, set(lines)
    for number, line in enumerate(text.split("\n")):
        start, end = at, at + len(line)
        at = end + 1
        if number in gone:
            continue
        left, place = "", start
        for a, b in holes:
            if b <= place or a >= end:
                continue
            left += text[place : max(place, a)]
            place = min(b, end)
        if place > start:
            line = left + text[place:end]
            if not WORD.search(line):
                continue
        kept.append(line)
    return "\n".join(kept)


def remove_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row of ``docs``, columns unchanged, its text freed of the lines and passages that go.

    Only line and word numbers are joined to the texts: broadcast if they are few, by a shuffle otherwise.
    """
    lines = repeated_paragraphs(docs, id_col, text, **options).where("removed").select("id", "version", "line", F.lit(None).cast(SPAN).alias("span"))
    spans = repeated_passages(text_rows(docs, id_col, text)).select("id", "version", F.lit(None).cast("int").alias("line"), F.struct("first_word", "n_words").alias("span"))
    of, at, what = tx.fresh_names(docs, "of", "at", "removed")
    both = lines.unionByName(spans).groupBy(F.col("id").alias(of), F.col("version").alias(at))
    gone = cut_lineage(both.agg(F.struct(F.collect_set("line").alias("lines"), F.collect_set("span").alias("spans")).alias(what)))
    size = gone.agg(F.sum(F.size(f"{what}.lines") * 4 + F.size(f"{what}.spans") * 16 + 64)).first()[0] or 0
    t = docs[f"`{text}`"]
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(at))
    joined = docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, same, "left")

    def cleaned(texts: pa.Array, removed: pa.Array) -> pa.Array:
        rows = zip(texts, removed, strict=True)  # one row at a time as Python objects
        found = ((x.as_py(), r.as_py()) for x, r in rows)
        return pa.array(
            [x if x is None or r is None else without_repeats(x, r["lines"], [(s["first_word"], s["n_words"]) for s in r["spans"]]) for x, r in found],
            pa.string(),
        )

    # only texts that lose something go to Python, and filters on the new text do not make it twice
    loses = F.col(what).isNotNull()
    once = F.arrow_udf(cleaned, "string").asNondeterministic()
    clean = F.when(loses, once(F.when(loses, t), F.col(what))).otherwise(t)
    return joined.select(*[clean.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Repeated lines and passages in one table: (id, line, first_word, n_words, kept_id, cluster, members, removed).

    A line has no ``first_word`` and ``n_words``, a passage no ``line``, ``cluster`` and ``members``.
    """
    lines = repeated_paragraphs(docs, id_col, text, **options)
    passages = repeated_passages(text_rows(docs, id_col, text)).withColumn("removed", F.lit(True))
    return lines.unionByName(passages, allowMissingColumns=True).select("id", "line", "first_word", "n_words", "kept_id", "cluster", "members", "removed")
