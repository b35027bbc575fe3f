"""From shared signatures to exactly verified links and their connected components.

Links, components and fingerprints stay in Spark tables. Groups are linked to a pivot first; only where
that leaves several components are their pairs looked at, inside tasks, and only likely ones come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import cut_lineage

BROADCAST_IDS = 1_000_000  # 8 MB of ids at most; beyond it the ids are joined by a shuffle
SLICE_BYTES = 256 << 10  # of text whose shingles a task holds at once
PERCENT = 75
GROUP_BLOCK = 4096
SENT_PAIRS = 2_000_000


def star_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (node, rep): every node with the smallest node that shares a ``sig`` with it."""
    rep = F.min("node").over(Window.partitionBy("sig"))
    return rows.withColumn("rep", rep).filter("node <> rep").select("node", "rep").distinct()


def with_ids(table: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of ``table`` whose ``on`` is in ``ids`` (one column ``on``, written before)."""
    few = ids.count() <= BROADCAST_IDS
    return table.join(F.broadcast(ids) if few else ids, on, "left_semi")


def paired_texts(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, rep, node_text, rep_text) for written ``pairs``.

    ``fetch`` gives (node, text) for a written table of nodes, so only texts that some pair names are
    shuffled. The join on rep comes last: a representative of many nodes is split by adaptive
    execution like any skewed join.
    """
    ids = cut_lineage(pairs.select("node").union(pairs.select(F.col("rep").alias("node"))).distinct())
    wanted = fetch(ids)
    left = pairs.join(wanted.withColumnRenamed("text", "node_text"), "node")
    right = wanted.select(F.col("node").alias("rep"), F.col("text").alias("rep_text"))
    return left.join(right, "rep").select("node", "rep", "node_text", "rep_text")


def similar(
    paired: DataFrame, width: int, percent: int = PERCENT, key: Callable[[np.ndarray], int] | None = None
) -> DataFrame:
    """(node, rep) of the pairs with 100 * |A & B| >= percent * |A | B| on their shingle sets.

    With ``key``, nodes are keys of sets, and a text whose set has another key is passed over.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, rep_set = None, None
        for batch in batches:
            for part in tx.pieces(batch, "node_text", SLICE_BYTES):
                nodes, reps = part.column("node").to_pylist(), part.column("rep").to_pylist()
                keep = []
                for i, own in enumerate(tx.shingle_sets(part.column("node_text"), width)):
                    if rep_set is None or reps[i] != rep:
                        rep, rep_set = reps[i], tx.shingle_sets(part.column("rep_text").slice(i, 1), width)[0]
                    if key is not None and (key(own) != nodes[i] or key(rep_set) != reps[i]):
                        rep_set = None
                        continue
                    shared = len(np.intersect1d(own, rep_set, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(own) + len(rep_set) - shared):
                        keep.append(i)
                yield pa.RecordBatch.from_pydict(
                    {"node": pa.array([nodes[i] for i in keep], pa.int64()), "rep": pa.array([reps[i] for i in keep], pa.int64())}
                )

    return paired.mapInArrow(check, "node long, rep long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (node, rep).

    Alternating large-star and small-star rounds: every node is linked to the smallest of its
    neighbours until only stars are left. A hub's rows are aggregated before the shuffle and its
    join is a plain one that adaptive execution may split.
    """
    links = cut_lineage(edges.select(F.greatest("node", "rep").alias("u"), F.least("node", "rep").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    own = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(own)


def classes_of_pairs(
    pairs: DataFrame, docs: DataFrame, id_col: str, text: str, percent: int, width: int
) -> DataFrame:
    """(id, class_id) of the rows that verified ``pairs`` link to others."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    paired = paired_texts(cut_lineage(pairs), lambda ids: with_ids(texts, ids, "node"))
    edges = cut_lineage(similar(paired, width, percent).distinct())
    return components(edges).select(F.col("node").alias(id_col), F.col("label").alias("class_id"))


def sketch(values: np.ndarray, buckets: int) -> bytes:
    """One bit for each of a set's buckets: whether it holds an odd number of the hashes.

    There are ``buckets`` (a power of two) or more for a large set, one for each hash at least, so that
    sketches tell long texts apart as well as short ones.
    """
    width = max(buckets, 1 << len(values).bit_length())
    counts = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """A column of sketches, by width; halves of a wider one give the narrower by exclusive or."""

    def __init__(self, column: pa.Array) -> None:
        rows = column.to_pylist()
        self.width = np.array([len(r) for r in rows], np.int64)
        self.place = np.zeros(len(rows), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.rows[w] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), np.uint8).reshape(len(at), w)

    def at(self, index: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(index), width), np.uint8)
        for w in np.unique(self.width[index]).tolist():
            mine = np.flatnonzero(self.width[index] == w)
            out[mine] = np.bitwise_xor.reduce(self.rows[w][self.place[index[mine]]].reshape(len(mine), w // width, width), axis=1)
        return out


def may_be_similar(
    n: np.ndarray, m: np.ndarray, s: Sketches, i: np.ndarray, t: Sketches, j: np.ndarray, percent: int
) -> np.ndarray:
    """Whether sets of sizes n and m with sketches s[i] and t[j] can be similar.

    A hash in A ^ B turns one bit, so the sketches differ in |A ^ B| bits at most.
    """
    near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    pairs = np.flatnonzero(near)
    width = np.minimum(s.width[i[pairs]], t.width[j[pairs]])
    for w in np.unique(width).tolist():
        same = pairs[width == w]
        step = max(1, (1 << 21) // w)
        for first in range(0, len(same), step):
            at = same[first : first + step]
            apart = np.bitwise_count(s.at(i[at], w) ^ t.at(j[at], w)).sum(axis=1, dtype=np.int64)
            near[at] = apart * (100 + percent) <= (100 - percent) * (n[at] + m[at])
    return near


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (node, rep) that the sizes and sketches of ``sets`` (node, n, sketch) do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            rows = np.arange(batch.num_rows)
            near = may_be_similar(n, m, Sketches(batch.column("s")), rows, Sketches(batch.column("t")), rows, percent)
            yield batch.select(["node", "rep"]).filter(pa.array(near))

    sized = pairs.join(sets.select("node", "n", F.col("sketch").alias("s")), "node")
    sized = sized.join(sets.select(F.col("node").alias("rep"), F.col("n").alias("m"), F.col("sketch").alias("t")), "rep")
    return sized.select("node", "rep", "n", "m", "s", "t").mapInArrow(run, "node long, rep long")


def pairs_inside(start: np.ndarray, size: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, inside runs of rows, about ``limit`` at a time."""
    owner = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    left = start[owner] + place
    partners = size[owner] - 1 - place
    ends = np.cumsum(partners)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        i = np.repeat(left[at:to], partners[at:to])
        step = np.arange(len(i)) - np.repeat(np.cumsum(partners[at:to]) - partners[at:to], partners[at:to])
        yield i, i + 1 + step
        at = to


def near_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (node, rep) of different labels that share a signature and may be similar.

    ``rows``: (sig, rn, count, node, label, n, sketch). Groups are compared as arrays inside tasks, and
    only pairs that sizes and sketches allow come out. A group of more than GROUP_BLOCK rows is cut
    into blocks and every two blocks meet in a task of their own.
    """
    block = F.floor((F.col("rn") - 1) / GROUP_BLOCK).cast("int")
    blocks = F.ceil(F.col("count") / GROUP_BLOCK).cast("int")
    spread = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = spread.select(
        "sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n", "sketch"
    )

    def compare(table: pa.Table) -> np.ndarray:
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("sig", "x", "y")])
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if table.num_rows else np.zeros(0, np.int64)
        size = np.diff(np.append(first, table.num_rows))
        node, label, n, own = (table.column(c).to_numpy() for c in ("node", "label", "n", "own"))
        apart = key[1] != key[2]  # two blocks: only pairs across them are new
        s = Sketches(table.column("sketch"))
        found = [np.zeros((0, 2), np.int64)]
        for i, j in pairs_inside(first, size, 1 << 18):
            fresh = (label[i] != label[j]) & (node[i] != node[j]) & (~apart[i] | (own[i] != own[j]))
            i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            low, high = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            _, once = np.unique(np.stack([low, high]), axis=1, return_index=True)
            i, j, low, high = i[once], j[once], low[once], high[once]
            near = may_be_similar(n[i], n[j], s, i, s, j, percent)
            found.append(np.stack([high[near], low[near]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sent = np.zeros(0, np.int64)

        def once(both: np.ndarray) -> pa.RecordBatch:
            """Pairs that this task has not sent yet; it forgets them when they are too many to keep."""
            nonlocal sent
            with np.errstate(over="ignore"):
                key = tx.mix(both[:, 0].astype(np.uint64) * tx.BASE + tx.mix(both[:, 1].astype(np.uint64))).view(np.int64)
            new = ~np.isin(key, sent)
            sent = np.concatenate([sent if len(sent) < SENT_PAIRS else sent[:0], key[new]])
            return pa.RecordBatch.from_pydict({"node": both[new, 0], "rep": both[new, 1]})

        total, weight = 0, 0
        for batch in batches:
            # whole groups are compared once enough rows have come; the last, maybe unfinished one waits
            held.append(batch)
            total, weight = total + batch.num_rows, weight + batch.nbytes
            if total < 20_000 and weight < 16 << 20:
                continue
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("sig", "x", "y")])
            same = (key == key[:, -1:]).all(axis=0)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield once(compare(table.slice(0, cut)))
            held = table.slice(cut).to_batches()
            total, weight = table.num_rows - cut, 0
        if held:
            yield once(compare(pa.Table.from_batches(held)))

    ordered = keyed.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return ordered.mapInArrow(run, "node long, rep long").distinct()


def several_labels(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (sig, node, rn, count) of the groups that hold several components, with their ``label``."""
    whole = Window.partitionBy("sig")
    named = rows.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = named.withColumn("a", F.min("label").over(whole)).withColumn("z", F.max("label").over(whole))
    return cut_lineage(spread.filter("a <> z").select("sig", "node", "rn", "count", "label"))


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """``pairs`` without those that ``tested`` holds, in whichever order."""
    turned = tested.union(tested.select(F.col("rep").alias("node"), F.col("node").alias("rep"))).distinct()
    return pairs.join(turned, ["node", "rep"], "left_anti")


def closed_links(
    multi: DataFrame, sets: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int = PERCENT
) -> DataFrame:
    """Every link between nodes that share a ``sig``, up to components, as edges (node, rep).

    ``multi`` (sig, node, rn, count): groups of two nodes or more; ``sets`` (node, n, sketch). First
    every node is compared with one pivot, the node of its groups whose own groups hold most rows: the
    text that others are copies of. Groups whose nodes are then in one component are done. In the
    others all pairs across components are screened by size and sketch inside tasks, and what is left
    is verified.
    """
    weight = multi.groupBy("node").agg(F.sum("count").alias("weight"))
    weighed = multi.join(weight, "node").withColumn("own", F.struct("weight", "node"))
    pivots = weighed.withColumn("pivot", F.max("own").over(Window.partitionBy("sig"))).filter("pivot <> own")
    first = pivots.groupBy("node").agg(F.max("pivot").alias("pivot")).select("node", F.col("pivot.node").alias("rep"))
    tested = cut_lineage(plausible(first, sets, percent))
    edges = cut_lineage(verify(tested).distinct())
    rest = near_pairs(several_labels(multi, edges).join(sets, "node"), percent)
    fresh = cut_lineage(untested(rest, tested))
    return cut_lineage(edges.union(verify(fresh)).distinct())
