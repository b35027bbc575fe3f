"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct five-word shingles (A-Z lower-cased). Two documents link when
100 * |A & B| >= 75 * |A | B|. Then |A ^ B| <= (|A| + |B|) / 7 and the sizes differ by at most a third,
so a set of size s differs from any partner in at most k(s) features.

Sets fall into size bands a factor of 16 wide; a set near the top of its band also joins the next
one, so partners always meet in the band of the larger. In a band the leading bits of the feature
hash cut the domain into partitions, half as many as the band's upper end and 256 at least, more than
any k of the band. Two side by side are a first-level partition of n2 = 2 second-level ones, and of
its subsets those of one are enumerated: a signature is the content of one of the partitions. A
differing feature spoils one partition, so partners of whom one has e > k non-empty partitions share
at least e - k non-empty signatures, and by the prefix argument one among the k + 1 smallest of each
under any common order. The order puts contents made only of features found in many documents
last; that list is bounded and need not be exact, for it changes the order and no result. A set with
e <= k non-empty partitions also sends its empty ones, of which every pair then shares one.

Equal sets are joined by their key before; signatures that two sets share are candidates. A candidate
first compares two bit sketches of its features, one bit or more a feature: they differ in |A ^ B| bits at
most, so what it rules out is no link. The rest is verified exactly on the whole texts. Hashes are 64 bits
throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.llm.links import BROADCAST_IDS, SLICE_BYTES, closed_links, components, paired_texts, similar, sketch
from tabloom.session import cut_lineage

WIDTH = 5
PERCENT = 75
BAND = 16
LEAST_PARTITIONS = 256
COMMON_BATCH = 1_000_000  # features counted together in a task
COMMON_DOCS = 2
COMMON_KEPT = 500_000  # features of the order's tail, 4 MB
BUCKETS = 1024

U = np.uint64


def most_different(size: int, percent: int = PERCENT) -> int:
    """The largest |A ^ B| over the partners B of a set of ``size``."""
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


def band_of(size: int) -> int:
    """0 for 1 to 15, 1 for 16 to 255, ..."""
    return (size.bit_length() - 1) // 4


def partition_bits(band: int) -> int:
    """log2 of the number of partitions: half the band's upper end, 256 at least."""
    return max(LEAST_PARTITIONS.bit_length() - 1, 4 * (band + 1) - 1)


def set_key(values: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(tx.mix(tx.mix(values + tx.BASE).sum(dtype=U)[None] + U(len(values)))[0].view(np.int64))


def signatures(values: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of one sorted set of feature hashes."""
    size = len(values)
    k = most_different(size, percent)
    if k == 0:  # no different set is similar
        return np.zeros(0, np.int64)
    bands = {band_of(size), band_of(100 * size // percent)}
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        rare = common[at] != values
    else:
        rare = np.ones(size, bool)
    out = []
    with np.errstate(over="ignore"):
        mixed = tx.mix(values + tx.PLACE_CODE[0])
        for band in sorted(bands):
            bits = partition_bits(band)
            part = values >> U(64 - bits)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            salt = U(band + 1) * tx.BASE
            sig = tx.mix(np.add.reduceat(mixed, starts) + tx.mix(part[starts] + salt))
            if len(sig) > k:
                some_rare = np.maximum.reduceat(rare, starts)
                order = (sig >> U(1)) | np.where(some_rare, U(0), U(1) << U(63))
                sig = sig[np.argpartition(order, k)[: k + 1]] if len(sig) > k + 1 else sig
            else:
                empty = np.setdiff1d(np.arange(1 << bits, dtype=U), part[starts], assume_unique=True)
                sig = np.concatenate([sig, tx.mix(empty + salt)])
            out.append(sig)
    return np.concatenate(out).view(np.int64)


DESCRIBED = {"id": pa.int64(), "version": pa.int64(), "n_shingles": pa.int64(), "key": pa.int64(), "sketch": pa.binary(), "feature": pa.int64(), "n": pa.int64()}


def described(docs: DataFrame) -> DataFrame:
    """From (id, version, text): rows (id, version, n_shingles, key, sketch) and rows (feature, n) of features met again."""
    return docs.mapInArrow(describe, "id long, version long, n_shingles long, key long, sketch binary, feature long, n long")


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    held: list[np.ndarray] = []
    total = 0

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held or [np.zeros(0, U)])
        held.clear()
        values.sort()
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        counts = np.diff(starts, append=len(values))
        many = counts >= COMMON_DOCS
        return batch_of(feature=values[starts[many]].view(np.int64), n=counts[many].astype(np.int64))

    def batch_of(**given) -> pa.RecordBatch:
        rows = len(next(iter(given.values())))
        arrays = [pa.array(given[c], kind) if c in given else pa.nulls(rows, kind) for c, kind in DESCRIBED.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(DESCRIBED))

    for batch in batches:
        for part in tx.pieces(batch, "text", SLICE_BYTES):
            sets = tx.shingle_sets(part.column("text"), WIDTH)
            keys = [set_key(s) for s in sets]
            yield batch_of(id=part.column("id"), version=part.column("version"), n_shingles=np.array([len(s) for s in sets], np.int64), key=np.array(keys, np.int64), sketch=[sketch(s, BUCKETS) for s in sets])
            for key, values in zip(keys, sets, strict=True):
                if key not in seen:
                    seen.add(key)
                    held.append(values)
                    total += len(values)
            if total >= COMMON_BATCH:
                yield often(held)
                total = 0
    yield often(held)


def common_features(facts: DataFrame) -> np.ndarray:
    """The features met most often, COMMON_KEPT at most: those from the lowest count that leaves so few."""
    often = facts.filter("feature IS NOT NULL").groupBy("feature").agg(F.least(F.sum("n"), F.lit(10_000)).alias("n"))
    often = cut_lineage(often)
    least, total = 10_001, 0
    for row in sorted(often.groupBy("n").count().collect(), reverse=True):  # 10,000 rows at most
        total += row["count"]
        if total > COMMON_KEPT:
            break
        least = row["n"]
    kept = often.filter(F.col("n") >= least).select("feature").toArrow()
    return np.sort(kept.column("feature").to_numpy().astype(np.int64).view(U))


def signature_rows(docs: DataFrame, last: np.ndarray, percent: int) -> DataFrame:
    """(sig, node) for every signature; a set that a task has met before is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in tx.pieces(batch, "text", SLICE_BYTES):
                sigs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for values in tx.shingle_sets(part.column("text"), WIDTH):
                    key = set_key(values)
                    if len(values) and key not in seen:
                        seen.add(key)
                        sigs.append(signatures(values, last, percent))
                        nodes.append(np.full(len(sigs[-1]), key, np.int64))
                yield pa.RecordBatch.from_pydict({"sig": np.concatenate(sigs), "node": np.concatenate(nodes)})

    return docs.mapInArrow(run, "sig long, node long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included. Texts without
    words (nulls and empty ones too) have no shingle and link with nothing, not even with each
    other. Rows that repeat an id are linked by each of their texts. A row with a null id takes the
    component of rows with an equal set, else null, and links no others. Other columns are not read.
    """
    rows, by_key = linked_sets(docs, id_col, text, percent)
    alone = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = rows.join(by_key, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", alone.alias("component_id"))


def surplus_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, version, copies, kept) of the texts with words that stand in a component of several rows.

    ``version`` is xxhash64 of the text, ``copies`` the number of rows equal in both. The first text of each
    component in the order of id (null last) and version is ``kept``.
    """
    rows, by_key = linked_sets(docs, id_col, text, percent)
    placed = rows.filter("n_shingles > 0").groupBy("id", "version", "key").agg(F.count(F.lit(1)).alias("copies"))
    placed = cut_lineage(placed.join(by_key.select("key", "label"), "key"))
    spot = F.struct(F.col("id").isNull().alias("last"), "id", "version")
    whole = placed.groupBy("label").agg(F.min(spot).alias("first"), F.sum("copies").alias("total")).filter("total > 1")
    return placed.join(whole, "label").select("id", "version", "copies", spot.eqNullSafe(F.col("first")).alias("kept"))


def linked_sets(docs: DataFrame, id_col: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, version, n_shingles, key) of every row and (key, label, component_id) of every set."""
    t = F.col(f"`{text}`")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("version"), t.alias("text"))
    facts = cut_lineage(described(named))
    common = common_features(facts)
    rows = facts.filter("n_shingles IS NOT NULL").select("id", "version", "n_shingles", "key")
    by_key = facts.filter("n_shingles > 0").groupBy("key")
    classes = cut_lineage(by_key.agg(F.min("id").alias("first"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch")))

    group = Window.partitionBy("sig")
    numbered = signature_rows(named.filter("id IS NOT NULL"), common, percent).select(
        "sig",
        "node",
        F.row_number().over(group.orderBy("node")).alias("rn"),
        F.min("node").over(group).alias("low"),
        F.max("node").over(group).alias("top"),
        F.count(F.lit(1)).over(group).alias("count"),
    )
    multi = cut_lineage(numbered.filter("low < top").drop("low", "top"))
    sets = classes.select(F.col("key").alias("node"), "n", "sketch")

    def fetch(keys: DataFrame) -> DataFrame:
        located = cut_lineage(keys.join(classes.select(F.col("key").alias("node"), F.col("first").alias("id")), "node"))
        few = located.count() <= BROADCAST_IDS
        return named.join(F.broadcast(located) if few else located, "id").select("node", "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(paired_texts(pairs, fetch), WIDTH, percent, set_key)

    edges = closed_links(multi, sets, verify, percent)
    label = components(edges)
    labelled = cut_lineage(
        classes.join(label, classes["key"] == label["node"], "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows, labelled.join(smallest, "label").select("key", "label", "component_id")
