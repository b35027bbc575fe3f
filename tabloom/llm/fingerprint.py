"""MinHash fingerprints of documents.

A text's shingles are its runs of five words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text with
fewer words is one shingle, a text without words has none. Each of ``PERMUTATIONS`` universal hash
functions x -> a x + b (mod 2**64, a odd) keeps its smallest value over the shingles; a fingerprint
holds 16 bits of each minimum as hex. The share of equal places estimates the Jaccard similarity
(standard error at most 0.045 for 128 places). Equal texts have equal fingerprints; two texts
without words are alike (1.0).

``document_classes`` cuts the minima into bands, groups texts that agree on a band in Spark and closes
the pairs whose exact Jaccard similarity reaches the threshold to classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.llm.links import BROADCAST_IDS, closed_links, components, paired_texts, similar, sketch
from tabloom.llm.ngram_join import BUCKETS, set_key
from tabloom.session import cut_lineage

SHINGLE_WORDS = 5
PERMUTATIONS = 128
BANDS = 32
PERCENT = 75
BLOCK_BITS = 11  # documents are ordered in blocks of at most 2048 ids
WORK_BYTES = 1 << 20
_draw = np.random.RandomState(711)
FACTOR = _draw.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _draw.randint(0, 1 << 62, PERMUTATIONS, dtype=np.int64).view(np.uint64) * np.uint64(4)


def minima(column: pa.Array) -> np.ndarray:
    """The smallest hash of each text (row) under each permutation; all ones for no shingle."""
    words, counts = tx.word_hashes(column)
    values, sizes = tx.shingles(words, counts, SHINGLE_WORDS)
    out = np.full((PERMUTATIONS, len(sizes)), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        with np.errstate(over="ignore"):
            for p in range(PERMUTATIONS):
                out[p, some] = np.minimum.reduceat(values * FACTOR[p] + SHIFT[p], starts)
    return out.T


def places(low: np.ndarray) -> np.ndarray:
    return (low >> np.uint64(32)).astype(">u2")


def as_text(codes: np.ndarray) -> list[str]:
    whole = codes.tobytes().hex()
    width = 4 * PERMUTATIONS
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of RESULT for texts and the text after each."""
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, following, halves, strict=True)]
    own = places(minima(pa.array(texts, pa.string())))
    changed = places(minima(pa.array(edited, pa.string())))
    if texts[1:] == following[:-1]:  # a run of neighbours: only the last one's follower is new
        after = np.concatenate([own[1:], places(minima(pa.array(following[-1:], pa.string())))])
    else:
        after = places(minima(pa.array(following, pa.string())))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(as_text(own), pa.string()),
        pa.array(as_text(changed), pa.string()),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, after)),
    ]


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", version: str | None = None
) -> DataFrame:
    """Fingerprint of every text and of its edited form, one row per row of ``docs``.

    The edited form replaces the last floor(n_chars / 2) code points by the first as many of the
    next document in descending id order (the first document follows the last). Repeated ids follow
    each other in text order; null texts count as empty; rows with a null id have no place in the
    order and get null results beside their own fingerprint. Other columns are not read. xxhash64 of the text goes
    into the column ``version``, if named.

    Texts are shuffled once, by blocks of neighbouring ids; a task streams over its sorted rows.
    Only the last row of a block needs a text of another block: these few pairs are joined apart.
    """
    rows = docs.select(
        F.shiftright(F.col(f"`{id_col}`").cast("long"), BLOCK_BITS).alias("block"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text"))
    schema = "id long, version long, " + RESULT

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for part in tx.pieces(batch, "text", WORK_BYTES):
                block = part.column("block").to_pylist()
                ids, texts, versions = (part.column(c).to_pylist() for c in ("id", "text", "version"))
                if held is not None:
                    block, ids, texts, versions = [held[0], *block], [held[1], *ids], [held[2], *texts], [held[3], *versions]
                held = (block[-1], ids[-1], texts[-1], versions[-1])
                # runs of one block: each row but the last has its follower here
                at = 0
                while at < len(ids):
                    to = at
                    while to + 1 < len(ids) and block[to + 1] == block[at]:
                        to += 1
                    if to > at and block[at] is not None:
                        out = [pa.array(ids[at:to], pa.int64()), pa.array(versions[at:to], pa.int64()), *compare(texts[at:to], texts[at + 1 : to + 1])]
                        yield pa.RecordBatch.from_arrays(out, names=names)
                    at = to + 1

    names = [c.split(" ")[0] for c in schema.split(", ")]

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", WORK_BYTES):
                out = compare(part.column("text").to_pylist(), part.column("following").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("version"), *out], names=names)

    neighbours = (
        rows.filter(F.col("id").isNotNull())
        .repartition("block")
        .sortWithinPartitions("block", F.desc("id"), "text")
        .mapInArrow(inside, schema)
    )
    edges = cut_lineage(block_edges(rows.select("block", "id")))
    last = rows.join(edges, rows["id"] == edges["low"]).groupBy("low", "next").agg(F.max("text").alias("text"))
    first = rows.join(edges.select(F.col("next").alias("want")).distinct(), F.col("id") == F.col("want"))
    first = first.groupBy("want").agg(F.min("text").alias("following"))
    pairs = last.join(first, F.col("next") == F.col("want")).select(F.col("low").alias("id"), F.xxhash64("text").alias("version"), "text", "following")
    alone = rows.filter("id IS NULL").select("id", "version", "text", F.lit("").alias("following")).mapInArrow(apart, schema)
    alone = alone.withColumns(
        {c: F.lit(None).cast(t) for c, t in (("edited_sha256", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))}
    )
    out = neighbours.unionByName(pairs.mapInArrow(apart, schema)).unionByName(alone)
    out = out.withColumnRenamed("version", version) if version else out.drop("version")
    return out.withColumnRenamed("id", id_col)


def fingerprints_and_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``fingerprint_documents`` with the near-duplicate class of every row and the number of its rows.

    A text that no other is like is a class of its own under its id, as is each text without words.
    Classes are broadcast if they are few and joined by a shuffle otherwise.
    """
    classes = cut_lineage(document_classes(docs, id_col, text))
    classes = classes.select(F.col("id").alias("__of"), F.col("version").alias("__at"), "class_id", "members")
    few = classes.count() <= BROADCAST_IDS
    rows = fingerprint_documents(docs, id_col, text, version="__version")
    same = F.col(id_col).eqNullSafe(F.col("__of")) & (F.col("__version") == F.col("__at"))
    joined = rows.join(F.broadcast(classes) if few else classes, same, "left")
    alone = F.col("__at").isNull()
    return joined.select(
        *[c for c in rows.columns if c != "__version"],
        F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("members")).cast("long").alias("class_members"),
    )


def block_edges(ids: DataFrame) -> DataFrame:
    """(low, next): the smallest id of each block and the id that follows it in descending order.

    Blocks are ordered in ranges, which are written; a range says its largest id, and only these, a row for each
    range, meet in one window, however the ids are spread.
    """
    blocks = ids.filter(F.col("id").isNotNull()).groupBy("block").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    ranged = cut_lineage(blocks.repartitionByRange("block").withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("range").agg(F.max("high").alias("top"))
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("top").over(whole.orderBy("range")), F.max("top").over(whole))
    inner = Window.partitionBy("range").orderBy("block")
    return (
        ranged.withColumn("next", F.lag("high").over(inner))
        .join(F.broadcast(ranges.select("range", before.alias("below"))), "range")
        .select("low", F.coalesce("next", "below").alias("next"))
    )


def set_rows(named: DataFrame) -> DataFrame:
    """(id, version, node, n, sketch) of each text with a shingle; ``version`` is xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text"):
                sets = tx.shingle_sets(part.column("text"), SHINGLE_WORDS)
                some = pa.array(np.flatnonzero([len(s) > 0 for s in sets]), pa.int64())
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(some),
                        part.column("version").take(some),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s, BUCKETS) for s in sets], pa.binary()),
                    ],
                    names=["id", "version", "node", "n", "sketch"],
                )

    return named.mapInArrow(run, "id long, version long, node long, n long, sketch binary")


def band_rows(named: DataFrame, bands: int) -> DataFrame:
    """(sig, node) for each band of each set with a shingle; a set that a task has met before is not sent again."""
    width = PERMUTATIONS // bands

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in tx.pieces(batch, "text", WORK_BYTES):
                fresh, nodes = [], []
                for i, values in enumerate(tx.shingle_sets(part.column("text"), SHINGLE_WORDS)):
                    key = set_key(values)
                    if len(values) and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                        nodes.append(key)
                if not fresh:
                    continue
                low = minima(part.column("text").take(pa.array(fresh, pa.int64())))
                with np.errstate(over="ignore"):
                    grouped = tx.mix(low.reshape(len(fresh), bands, width) + tx.PLACE_CODE[:width])
                    sig = tx.mix(grouped.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * tx.BASE)
                ids = np.repeat(np.array(nodes, np.int64), bands)
                yield pa.RecordBatch.from_arrays([pa.array(sig.reshape(-1).view(np.int64)), pa.array(ids)], names=["sig", "node"])

    return named.mapInArrow(cut, "sig long, node long")


def document_classes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS
) -> DataFrame:
    """(id, version, class_id, members) of every text that a chain of verified near-duplicate pairs joins to another.

    Every two texts that agree on one of ``bands`` bands are compared or already joined by others; links are
    verified exactly by the shingle sets. The class is the smallest id reachable, ``members`` counts its rows.
    ``version`` (xxhash64 of the text) tells rows of one id apart; rows equal in both are one here and
    count one by one in ``members``. A row with a null id belongs to the class of rows with an equal set and
    links no others. A pair of similarity 0.75 shares no band of four places with probability 6e-6.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("version"), t.alias("text"))
    facts = cut_lineage(set_rows(named))
    sets = cut_lineage(
        facts.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("members"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    )
    group = Window.partitionBy("sig")
    numbered = band_rows(named.filter("id IS NOT NULL").select("text"), bands).select(
        "sig",
        "node",
        F.row_number().over(group.orderBy("node")).alias("rn"),
        F.min("node").over(group).alias("low"),
        F.max("node").over(group).alias("top"),
        F.count(F.lit(1)).over(group).alias("count"),
    )
    multi = cut_lineage(numbered.filter("low < top").drop("low", "top"))

    def fetch(nodes: DataFrame) -> DataFrame:
        located = cut_lineage(nodes.join(sets.select("node", F.col("first").alias("id")), "node"))
        few = located.count() <= BROADCAST_IDS
        return named.join(F.broadcast(located) if few else located, "id").select("node", "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(paired_texts(pairs, fetch), SHINGLE_WORDS, percent, set_key)

    label = components(closed_links(multi, sets.select("node", "n", "sketch"), verify, percent))
    labelled = cut_lineage(sets.join(label, "node", "left").select("node", "first", "members", F.coalesce("label", "node").alias("label")))
    whole = labelled.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("members").alias("members")).filter("members > 1")
    by_node = cut_lineage(labelled.select("node", "label").join(whole, "label").select("node", "class_id", "members"))
    few = by_node.count() <= BROADCAST_IDS
    return facts.select("id", "version", "node").distinct().join(F.broadcast(by_node) if few else by_node, "node").drop("node")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS
) -> DataFrame:
    """(id, class_id) of the texts that ``document_classes`` joins to another."""
    classes = document_classes(docs, id_col, text, percent, bands)
    return classes.select(F.col("id").alias(id_col), "class_id")
