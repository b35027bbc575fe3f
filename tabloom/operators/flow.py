"""Flow-matching synthesizer on boosted trees grown level by level as Spark jobs.

For every time level t (and label) the model learns the field X - Z at X_t = (1-t) Z + t X by boosted trees
whose leaves hold a vector, one value for each output. The bins of X_t and the residuals are blocks of a
persisted RDD; a round grows one tree for every model, a job for each level of depth that adds the residuals
into histograms. Of the two children of a node only the smaller one's rows are added up, the other's sums are what is left of
the node's; the sums at the root follow from how many rows of each bin the last tree's leaves hold. What the last trees
explain is taken off as residuals are read, and every REWRITE_ROUNDS rounds for good. A checkpoint
every CHECKPOINT_ROUNDS rounds keeps the lineage short, so no round depends on the number of rounds before it.
These jobs are many and short: as RDD jobs they are spared the planning of a query. Sums of up to HELD_BYTES come to the
driver, of more only the splits; the forest is a table by level and label.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import key_hash, key_uniform, normals
from ..session import cut_lineage, scratch_root
from .features import as_matrix
from .sampling import label_distribution

GROUP_CUTS = 500_000  # best cuts of one level of depth that come to the driver; more models are grown in several groups
GROUP_BYTES = 128 << 20  # trees of some rounds that are sent to tasks at once
BLOCK, STATE_BLOCK, LEAST_BLOCK = 16_384, 32_768, 1024  # rows of a block of samples and of the state, as many as BLOCK_BYTES hold
BLOCK_BYTES = 1 << 20
HIST_BYTES = 32 << 20  # of histograms that a task holds at once
HELD_BYTES = 32 << 20  # of all models' sums that the driver keeps for the next level of depth
DIRECT_BYTES = 64 << 20  # of all tasks' histograms that the driver adds up itself; larger ones are summed by a shuffle
MASKED_DEPTH = 6  # levels of a tree that rows pass by masks of bytes, a mask for each node
REWRITE_ROUNDS = 2
CHECKPOINT_ROUNDS = 10
PART_BYTES = 128 << 20  # of the state in one task
LEAST_PART_BYTES = 4 << 20
LABEL_PARTS = 256
LABEL_CELLS = 4096
STEPS_A_PLAN = 8  # levels that one plan walks through before it is written
STATE = "lab int, level int, n int, binned binary, residual binary, weight binary"
BLOCKS = "lab int, ids binary, x binary"


@dataclass(frozen=True)
class FlowParams:
    """Defaults are the production setting; tests pass smaller numbers."""

    nt: int = 50
    n_noise: int = 100
    trees: int = 100
    depth: int = 6
    learning_rate: float = 0.1
    l2: float = 0.0
    bins: int = 64  # at most 256
    seed: int = 42

    def level(self, i: int) -> float:
        return (i + 1) / self.nt


def interpolate(x: np.ndarray, z: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(X_t, target field) of the straight path from noise to data."""
    return (1.0 - t) * z + t * x, x - z


def training_pairs(df: DataFrame, key: Sequence[str], params: FlowParams, vec: str = "features") -> DataFrame:
    """(key..., rep, level, x_t, y_t): the pairs the trees are fitted to, for inspection and tests."""
    dims = df.select(F.size(vec).alias("d")).first()["d"]
    fields = [df.schema[k] for k in key]
    schema = T.StructType(
        [
            *fields,
            T.StructField("rep", T.IntegerType()), T.StructField("level", T.IntegerType()),
            T.StructField("x_t", T.ArrayType(T.DoubleType())), T.StructField("y_t", T.ArrayType(T.DoubleType())),
        ]
    )

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, base = as_matrix(pdf["features"]), pdf["_base"].to_numpy()
            for rep in range(params.n_noise):
                z = normals(base, rep, dims)
                for ti in range(params.nt):
                    x_t, y_t = interpolate(x, z, params.level(ti))
                    yield pdf[list(key)].assign(rep=rep, level=ti, x_t=list(x_t), y_t=list(y_t))

    rows = complete_rows(df, vec).select(*key, F.col(vec).alias("features"), key_hash(key, params.seed).alias("_base"))
    return rows.mapInPandas(pairs, schema)


def complete_rows(df: DataFrame, vec: str = "features") -> DataFrame:
    """Rows whose array has neither null nor NaN."""
    return df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v)))


def bin_edges(t: float, bins: int) -> np.ndarray:
    """Inner edges of the grid of X_t: data in [-1, 1] blended with a normal, so the range is known."""
    reach = t + (1.0 - t) * 4.0 + 1e-6
    return np.linspace(-reach, reach, bins + 1)[1:-1]


def rows_a_block(most: int, row_bytes: int) -> int:
    return min(most, max(LEAST_BLOCK, BLOCK_BYTES // row_bytes))


def joined(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The batches, small ones put together up to ``size`` rows."""
    some, n = [], 0
    for pdf in batches:
        if n and n + len(pdf) > size:
            yield pd.concat(some)
            some, n = [], 0
        some.append(pdf)
        n += len(pdf)
    if n:
        yield pd.concat(some)


def bins_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="left").astype(np.uint8)


def walk(feature: np.ndarray, cut: np.ndarray, binned: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row after ``depth`` levels of a tree; a leaf (feature -1) keeps its rows."""
    return walk_columns(feature, cut, np.ascontiguousarray(binned.T), depth)


def walk_columns(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """``walk`` over bins [feature, row]."""
    return reached(feature, depth).take(places(feature, cut, columns, depth))


def places(feature: np.ndarray, cut: np.ndarray, columns: np.ndarray, depth: int) -> np.ndarray:
    """Place of each row among the 2**depth nodes of a level; below a leaf its rows go left."""
    n = columns.shape[1]
    at, masks = np.zeros(n, np.uint8), [np.ones(n, bool)]
    for level in range(min(depth, MASKED_DEPTH)):
        below, turned = [], np.zeros(n, bool)
        for node, own in enumerate(masks, 2**level - 1):
            if own is None or feature[node] < 0:
                below += [own, None]
                continue
            right = columns[feature[node]] > cut[node]
            right &= own
            turned |= right
            if level + 1 < depth:
                below += [own ^ right, right]
        masks = below
        at += at
        at += turned.view(np.uint8)
    if depth <= MASKED_DEPTH:
        return at
    flat, rows, at = columns.ravel(), np.arange(n), at.astype(np.int64)
    offset = np.maximum(feature, 0).astype(np.int64) * n
    least = np.where(feature < 0, 255, cut).astype(np.uint8)  # no bin lies above 255: a leaf's rows never turn right
    for level in range(MASKED_DEPTH, depth):
        node = at + (2**level - 1)
        at += at
        at += flat.take(offset.take(node) + rows) > least.take(node)
    return at


def reached(feature: np.ndarray, depth: int) -> np.ndarray:
    """Node of each of the 2**depth places of a level: the leaf above where the tree ends before."""
    ids = np.zeros(1, np.int64)
    for level in range(depth):
        ends = (feature.take(ids) < 0) | (ids < 2**level - 1)
        ids = np.stack([np.where(ends, ids, 2 * ids + 1), np.where(ends, ids, 2 * ids + 2)], axis=1).ravel()
    return ids


@dataclass
class Trees:
    """The trees of one round, one for each model of a group: all outputs share a tree, a leaf holds a vector."""

    models: list[tuple[int, int]]  # (lab, level)
    feature: np.ndarray  # [model, node], -1 for a leaf
    cut: np.ndarray
    value: np.ndarray  # [model, node, output]
    placed: np.ndarray | None = None  # [model, output, place]: values of the places below all levels

    @classmethod
    def empty(cls, models: list[tuple[int, int]], depth: int, dims: int) -> "Trees":
        n, nodes = len(models), 2 ** (depth + 1) - 1
        return cls(models, np.full((n, nodes), -1, np.int16), np.zeros((n, nodes), np.uint8), np.zeros((n, nodes, dims), np.float32))

    def index(self) -> dict[tuple[int, int], int]:
        return {m: i for i, m in enumerate(self.models)}

    def grown(self, depth: int) -> "Trees":
        self.placed = np.stack([v.take(reached(f, depth), axis=0).T for f, v in zip(self.feature, self.value)])
        return self


def best_cuts(hist: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms [..., 1 + output, node, bin]: each node's best gain, its bin, the sums left of it and all sums."""
    total = hist.sum(axis=-1)
    none = total[..., 0, :]
    if hist.shape[-1] < 2:
        return np.full(none.shape, -np.inf), np.zeros(none.shape, np.int64), total, total
    left = np.cumsum(hist, axis=-1)[..., :-1]
    right = total[..., None] - left

    def score(x: np.ndarray) -> np.ndarray:
        n, sums = x[..., 0, :, :] + l2, x[..., 1:, :, :]
        return np.where(n > 0, np.einsum("...onb,...onb->...nb", sums, sums) / np.where(n > 0, n, 1.0), 0.0)

    enough = (left[..., 0, :, :] >= 1) & (right[..., 0, :, :] >= 1)
    gain = np.where(enough, score(left) + score(right) - score(total[..., None]), -np.inf)
    at = np.argmax(gain, axis=-1)
    of = lambda a, i: np.take_along_axis(a, i[..., None], axis=-1)[..., 0]
    return of(gain, at), at, of(left, np.broadcast_to(at[..., None, :], total.shape)), total


def block_arrays(n: int, d: int, binned: bytes, residual: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Bins and residuals of a block, [feature, row] both, and the rows that each stands for, if not for itself alone."""
    return np.frombuffer(binned, np.uint8).reshape(d, n), np.frombuffer(residual, np.float32).reshape(d, n), np.frombuffer(weight) if weight else None


def merged(binned: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows [row, feature] of ``count`` samples each and their mean fields: bins once each, mean field and weight.

    Trees only see the bins, so samples of equal bins never part and count together.
    """
    rows = np.ascontiguousarray(binned).view(np.dtype((np.void, binned.shape[1]))).ravel()
    _, first, of, n = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
    sums = np.stack([np.bincount(of, weights=c, minlength=len(first)) for c in y.T], axis=1)
    return binned[first], sums / n[:, None], n * float(count)


def taken_off(pending: list[Trees], depth: int) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """Function of a model, bins and residuals [feature, row]: the residuals without what ``pending`` explain, tree by tree."""
    arrays = [(t.feature, t.cut, t.placed) for t in pending]

    def taken(model: int, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        for feature, cut, value in arrays:
            g = g - value[model].take(places(feature[model], cut[model], x, depth), axis=1)
        return g

    return taken


def added(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """The sum of each key's histograms."""
    sums: dict[int, np.ndarray] = {}
    for key, part in parts:
        if key in sums:
            sums[key] += np.frombuffer(part)
        else:
            sums[key] = np.frombuffer(part).copy()
    yield from sums.items()


def found_cuts(hist: np.ndarray, l2: float) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(model, (feature, gain, bin, left, total)) of histograms [model, feature, 1 + output, node, bin]: each node's best cut."""
    some = max(1, HIST_BYTES // 8 // max(1, hist[:1].nbytes))
    for low in range(0, len(hist), some):
        gain, at, left, total = best_cuts(hist[low : low + some], l2)
        top = gain.max(axis=1, keepdims=True)
        best = np.argmax(gain >= top - 1e-9 * np.abs(top), axis=1)  # of gains equal but for rounding the smallest feature
        nodes = np.arange(hist.shape[3])
        for i, feature in enumerate(best):
            yield low + i, (feature, gain[i, feature, nodes], at[i, feature, nodes], left[i, feature, :, nodes].T, total[i, feature, :, nodes].T)


@dataclass
class FlowSynthesizer:
    """fit on (key, features[, label]) rows, then sample any number of new feature rows.

    ``forest`` is a written table with a row for each model: (lab, level, feature, cut, value), the arrays of all
    its trees; ``label_table`` one with a row for each label: (label, lab, prob, low, high).
    """

    params: FlowParams = field(default_factory=FlowParams)
    forest: DataFrame | None = None
    label_table: DataFrame | None = None
    dims: int = 0
    tree_seconds: list[float] = field(default_factory=list)

    # -- training -----------------------------------------------------------------------

    def fit(
        self, df: DataFrame, key: Sequence[str], label: str | None = None, vec: str = "features"
    ) -> "FlowSynthesizer":
        p, spark = self.params, df.sparkSession
        rows = complete_rows(df, vec).withColumn("_base", key_hash(key, p.seed))
        if label is None:
            self.label_table, rows = None, rows.withColumn("_lab", F.lit(0))
        else:
            self.label_table = cut_lineage(numbered_labels(label_distribution(rows, label)))
            rows = rows.join(self.label_table.select(F.col("label").alias(label), F.col("lab").alias("_lab")), label)
        train = cut_lineage(rows.select(F.col(vec).alias("features"), F.col("_lab").alias("lab"), F.col("_base").alias("base")))
        first = train.first()
        if first is None:
            raise ValueError("no complete rows to train on")
        self.dims = len(first["features"])
        n_rows, n_labels = train.count(), 1 if label is None else self.label_table.count()
        state, path = self._first_state(train, n_rows)
        per_model = (2 ** (p.depth + 1) - 1) * (3 + 4 * self.dims)
        cuts = 2 ** max(p.depth - 1, 0) * self.dims
        group = max(1, min(GROUP_BYTES // (per_model * (1 + REWRITE_ROUNDS)), GROUP_CUTS // cuts) // p.nt)
        written = Written(spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}")
        self.tree_seconds = []
        for low in range(0, n_labels, group):
            models = [(lab, level) for lab in range(low, min(low + group, n_labels)) for level in range(p.nt)]
            part = state if group >= n_labels else state.where(F.col("lab").between(low, low + group - 1))
            own, before, files = part.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK), None, []
            last: Trees | None = None
            root: np.ndarray | None = None
            pending: list[Trees] = []
            kept = 0  # the round of the last checkpoint
            for tree in range(p.trees):
                began = time.perf_counter()
                last, root = self._grown(own, models, pending, last, root)
                written.add(last, tree)
                if before is not None:
                    before.unpersist()
                    before = None
                made = own.getCheckpointFile()
                if made and made not in files:
                    files.append(made)
                for old in files[:-1]:
                    drop_path(spark, old)
                files = files[-1:]
                pending = [*pending, last]
                if len(pending) == REWRITE_ROUNDS and tree + 1 < p.trees:
                    before, own, pending = own, self._moved_on(own, pending), []
                    if tree + 1 - kept >= CHECKPOINT_ROUNDS:
                        own.checkpoint()
                        kept = tree + 1
                self.tree_seconds.append(time.perf_counter() - began)
            own.unpersist()
            for old in files:
                drop_path(spark, old)
        drop_path(spark, path)
        self.forest = cut_lineage(
            written.table()
            .groupBy("lab", "level")
            .agg(F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "value"))).alias("trees"))
            .select("lab", "level", *[F.col("trees")[c].alias(c) for c in ("feature", "cut", "value")])
        )
        return self

    def _first_state(self, train: DataFrame, n_rows: int) -> tuple[DataFrame, str]:
        """Blocks (lab, level, n, binned, residual, weight): bins of X_t and the target field of up to STATE_BLOCK rows, feature by feature.

        Every row comes ``n_noise`` times at each level; at the end of the path (t = 1) the noise leaves the bins alone and the
        draws of a row are one row of that weight. Rows are sorted by label and key, and cut into
        ranges of up to PART_BYTES, so a task holds the histograms of one model at a time and a hot label has many tasks.
        """
        p, d, spark = self.params, self.dims, train.sparkSession
        size, width = n_rows * (p.n_noise * (p.nt - 1) + 1) * d * 5, spark.sparkContext.defaultParallelism
        parts = max(1, min(width, size // LEAST_PART_BYTES))
        if size > width * PART_BYTES:  # every core has as many parts
            parts = -(-size // (width * PART_BYTES)) * width
        edges = [bin_edges(p.level(i), p.bins) for i in range(p.nt)]

        block, columns = rows_a_block(STATE_BLOCK, 5 * d), ["lab", "level", "n", "binned", "residual", "weight"]

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in joined(batches, block):
                for lab, part in pdf.groupby("lab", sort=True):
                    for low in range(0, len(part), block):
                        some = part.iloc[low : low + block]
                        x, base = as_matrix(some["features"]), some["base"].to_numpy()
                        mean = np.zeros_like(x)
                        for rep in range(p.n_noise):
                            z, out = normals(base, rep, d), []
                            mean += (x - z) / p.n_noise
                            for level in range(p.nt - 1):
                                x_t, y_t = interpolate(x, z, p.level(level))
                                out.append((lab, level, len(x), bins_of(edges[level], x_t).T.tobytes(), y_t.T.astype(np.float32).tobytes(), b""))
                            yield pd.DataFrame(out, columns=columns)
                        binned, y, weight = merged(bins_of(edges[-1], x), mean, p.n_noise)
                        last = (lab, p.nt - 1, len(y), binned.T.tobytes(), y.T.astype(np.float32).tobytes(), weight.tobytes())
                        yield pd.DataFrame([last], columns=columns)

        placed = train.repartitionByRange(int(parts), "lab", "base").sortWithinPartitions("lab", "base")
        made = placed.mapInPandas(blocks, STATE).sortWithinPartitions("lab", "level")
        return self._written(spark, made)

    def _written(self, spark: SparkSession, state: DataFrame) -> tuple[DataFrame, str]:
        path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        state.write.option("compression", "none").parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    def _grown(
        self, state: RDD, models: list[tuple[int, int]], pending: list[Trees], last: Trees | None, root: np.ndarray | None
    ) -> tuple[Trees, np.ndarray | None]:
        """One tree for every model, a job for each level of depth: histograms of the residuals, summed by Spark.

        ``pending`` are the trees that the residuals of ``state`` do not know yet, ``last`` is the tree before and ``root`` its
        histograms of all rows. Returns the trees and their ``root``.
        """
        p, d = self.params, self.dims
        trees = Trees.empty(models, p.depth, d)
        cell = len(models) * d * p.bins * 8
        held = cell * (1 + d) * 2 ** max(p.depth - 1, 0) <= HELD_BYTES
        hist, splits = None, None  # of the level above
        for depth in range(p.depth):
            first, grew = 2**depth - 1, False
            if not held:
                cuts = self._cuts(state, trees, depth, pending)
            else:
                if depth:
                    hist = self._children(state, trees, depth, pending, hist, splits)
                elif root is None or cell * 2**p.depth > HELD_BYTES:
                    root = hist = self._sums(state, trees, 0, [np.zeros(1, np.int64)] * len(models), pending)
                else:
                    root = hist = self._next_root(state, last, root)
                cuts = found_cuts(hist, p.l2)
            splits = []
            for model, (feature, gain, at, left, total) in cuts:
                if depth == 0:
                    trees.value[model, 0] = p.learning_rate * total[1:, 0] / (total[0, 0] + p.l2)
                for i in np.flatnonzero(gain > 1e-9 * np.maximum(total[0], 1.0)):
                    node, right = first + i, total[:, i] - left[:, i]
                    trees.feature[model, node], trees.cut[model, node] = feature[i], at[i]
                    trees.value[model, 2 * node + 1] = p.learning_rate * left[1:, i] / (left[0, i] + p.l2)
                    trees.value[model, 2 * node + 2] = p.learning_rate * right[1:] / (right[0] + p.l2)
                    splits.append((model, i, 2 * i + int(right[0] < left[0, i])))
                    grew = True
            if not grew:
                break
        return trees.grown(p.depth), root

    def _children(
        self, state: RDD, trees: Trees, depth: int, pending: list[Trees], above: np.ndarray, splits: list[tuple[int, int, int]]
    ) -> np.ndarray:
        """Histograms [model, feature, 1 + output, node, bin] of a level: of each split (model, node, smaller child) above, the smaller child
        is added up and the other is the rest."""
        slots = [np.full(2**depth, -1, np.int64) for _ in trees.models]
        for model, _, small in splits:
            slots[model][small] = slots[model].max() + 1
        sums = self._sums(state, trees, depth, slots, pending)
        hist = np.zeros((*above.shape[:3], 2**depth, above.shape[4]))
        for model, node, small in splits:
            hist[model, :, :, small] = own = sums[model, :, :, slots[model][small]]
            hist[model, :, :, small ^ 1] = rest = above[model, :, :, node] - own
            hist[model, :, :, small ^ 1] = np.where(rest[:, :1] > 0.5, rest, 0.0)  # what rounding leaves of a bin without rows
        return hist

    def _next_root(self, state: RDD, last: Trees, root: np.ndarray) -> np.ndarray:
        """Histograms of all rows after ``last``: a leaf takes its value off all its rows, so their number in each bin will do."""
        depth = self.params.depth
        counts = self._sums(state, last, depth, [np.arange(2**depth)] * len(last.models), None)
        out = root.copy()
        for model in range(len(last.models)):
            out[model, :, 1:, 0] -= np.einsum("fpb,op->fob", counts[model, :, 0], last.placed[model].astype(np.float64))
        return np.where(out[:, :, :1] > 0.5, out, 0.0)

    def _sums(self, state: RDD, trees: Trees, depth: int, slots: list[np.ndarray], pending: list[Trees] | None) -> np.ndarray:
        """[model, feature, 1 + output, slot, bin]: rows and residuals, the latter unless ``pending`` is None."""
        d, bins = self.dims, self.params.bins
        width, most = 1 if pending is None else 1 + d, max(1, *(int(s.max()) + 1 for s in slots))
        out = np.zeros((len(slots), d, width, most, bins))
        parts = self._partials(state, trees, depth, slots, most, pending)
        if out.nbytes * state.getNumPartitions() > DIRECT_BYTES:
            parts = self._shuffled(parts, len(slots) * d, out.nbytes).mapPartitions(lambda p: ((k, h.tobytes()) for k, h in added(p)), True)
        for key, part in parts.collect():
            out[divmod(key, d)] += np.frombuffer(part).reshape(out.shape[2:])
        return out

    def _cuts(self, state: RDD, trees: Trees, depth: int, pending: list[Trees]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """``found_cuts`` of a level where sums are too large for the driver: tasks find each feature's best cuts."""
        d, l2, bins, nodes = self.dims, self.params.l2, self.params.bins, 2**depth
        slots = [np.where(reached(f, depth) >= nodes - 1, np.arange(nodes), -1) for f in trees.feature]

        def cuts(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[tuple[int, int], tuple[np.ndarray, ...]]]:
            for key, hist in added(parts):
                yield divmod(key, d), best_cuts(hist.reshape(1 + d, nodes, bins), l2)

        keys = len(slots) * d
        parts = self._shuffled(self._partials(state, trees, depth, slots, nodes, pending), keys, keys * (1 + d) * nodes * bins * 8)
        best: dict[int, list] = {}
        for (model, feature), found in sorted(parts.mapPartitions(cuts, True).collect(), key=lambda c: c[0]):
            if model not in best:
                best[model] = [np.full(nodes, feature), *found]
                continue
            now = best[model]
            more = found[0] > now[1]  # of equal gains the smallest feature
            now[0][more] = feature
            for old, new in zip(now[1:], found):
                old[..., more] = new[..., more]
        yield from best.items()

    def _shuffled(self, parts: RDD, keys: int, size: int) -> RDD:
        return parts.partitionBy(min(keys, max(parts.ctx.defaultParallelism, size // HIST_BYTES)), int)

    def _partials(
        self, state: RDD, trees: Trees, depth: int, slots: list[np.ndarray], most: int, pending: list[Trees] | None
    ) -> RDD:
        """(model * features + feature, histogram [1 + output, slot, bin] as bytes) of a task's rows.

        ``slots`` has for each model the slot of every place of the level, -1 where rows are left out.
        """
        d, bins, all_depth = self.dims, self.params.bins, self.params.depth
        index, feature, cut = trees.index(), trees.feature, trees.cut
        width, cells = 1 if pending is None else 1 + d, most * bins
        held = max(1, HIST_BYTES // (d * width * cells * 8))  # models
        taken = taken_off(pending or [], all_depth)

        def partials(blocks: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
            sums: dict[int, np.ndarray] = {}

            def out() -> Iterator[tuple[int, bytes]]:
                for model, hist in sums.items():
                    for f in range(d):
                        yield model * d + f, hist[f].tobytes()
                sums.clear()

            for lab, level, n, binned, residual, weight in blocks:
                model = index[lab, level]
                if slots[model].max() < 0:
                    continue
                if model not in sums:
                    if len(sums) >= held:
                        yield from out()
                    sums[model] = np.zeros((d, width, cells))
                hist = sums[model]
                x, g, w = block_arrays(n, d, binned, residual, weight)
                at = slots[model].take(places(feature[model], cut[model], x, depth))
                live = np.flatnonzero(at >= 0)
                if len(live) < n:
                    x, at = x.take(live, axis=1), at.take(live)
                    g, w = g if pending is None else g.take(live, axis=1), w if w is None else w.take(live)
                at *= bins
                if pending is not None:
                    g = taken(model, x, g).astype(np.float64)
                    if w is not None:
                        g *= w
                for f in range(d):
                    cell = at + x[f]
                    hist[f, 0] += np.bincount(cell, weights=w, minlength=cells)
                    for o in range(width - 1):
                        hist[f, 1 + o] += np.bincount(cell, weights=g[o], minlength=cells)
            yield from out()

        return state.mapPartitions(partials)

    def _moved_on(self, state: RDD, pending: list[Trees]) -> RDD:
        """The state after some rounds: what their trees explain is taken off the residuals; computed by the next job."""
        d, index, taken = self.dims, pending[0].index(), taken_off(pending, self.params.depth)

        def update(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for lab, level, n, binned, residual, weight in blocks:
                x, g, _ = block_arrays(n, d, binned, residual, weight)
                yield lab, level, n, binned, taken(index[lab, level], x, g).tobytes(), weight

        return state.mapPartitions(update, True).persist(StorageLevel.MEMORY_AND_DISK)

    # -- sampling -----------------------------------------------------------------------

    def sample(
        self,
        spark: SparkSession,
        n: int,
        seed: int | None = None,
        direction: str = "forward",
        clip: tuple[float, float] | None = (-1.0, 1.0),
        partitions: int | None = None,
    ) -> DataFrame:
        """(id, [label,] features) rows.

        "forward" follows the trained path from noise (t=0) to data (t=1); "reverse" walks the
        time levels downwards with the same step sign. Samples travel as blocks of one label, and meet the
        trees of one level at a time, joined by label.
        """
        if self.forest is None:
            raise RuntimeError("fit the synthesizer first")
        p, d = self.params, self.dims
        size = rows_a_block(BLOCK, 8 * d)
        ids = spark.range(n, numPartitions=partitions) if partitions else spark.range(n)
        seed = p.seed if seed is None else seed
        rows = ids.withColumn("base", key_hash(["id"], seed + 1))
        if self.label_table is None:
            rows = rows.withColumn("lab", F.lit(0))
        else:
            rows = drawn_labels(rows, self.label_table, seed).repartitionByRange("lab", "id").sortWithinPartitions("lab", "id")

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lab, part in pdf.groupby("lab", sort=True):
                    for low in range(0, len(part), size):
                        some = part.iloc[low : low + size]
                        x = normals(some["base"].to_numpy(), 0, d)
                        yield pd.DataFrame({"lab": [lab], "ids": [some["id"].to_numpy().tobytes()], "x": [x.tobytes()]})

        made = rows.select("id", "base", "lab").mapInPandas(blocks, BLOCKS)
        for step, level in enumerate(range(p.nt) if direction == "forward" else reversed(range(p.nt))):
            made = self._stepped(made, level)
            if step % STEPS_A_PLAN == STEPS_A_PLAN - 1:
                made = cut_lineage(made)

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lab, ids, x in zip(*[batch.column(c).to_pylist() for c in ("lab", "ids", "x")]):
                    own = np.frombuffer(ids, np.int64)
                    x = np.frombuffer(x).reshape(len(own), d)
                    if clip is not None:
                        x = np.clip(x, *clip)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), lab, np.int32)), flat], names=["id", "lab", "features"])

        out = made.mapInArrow(unpacked, "id long, lab int, features array<double>")
        if self.label_table is None:
            return out.select("id", "features")
        return out.join(self.label_table.select("lab", "label"), "lab").select("id", "label", "features")

    def _stepped(self, blocks: DataFrame, level: int) -> DataFrame:
        """The blocks one step along the field of ``level``."""
        p, d = self.params, self.dims
        edges = bin_edges(p.level(level), p.bins)
        trees = self.forest.where(F.col("level") == level).drop("level")

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                moved = []
                for x, feature, cut, value in zip(*[batch.column(c).to_pylist() for c in ("x", "feature", "cut", "value")]):
                    x = np.frombuffer(x).reshape(-1, d)
                    binned = np.ascontiguousarray(bins_of(edges, x).T)
                    field = np.zeros_like(x)
                    for f, c, v in zip(feature, cut, value):
                        f = np.frombuffer(f, np.int16)
                        field += np.frombuffer(v, np.float32).reshape(len(f), d).take(walk_columns(f, np.frombuffer(c, np.uint8), binned, p.depth), axis=0)
                    moved.append((x + field / p.nt).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lab"), batch.column("ids"), pa.array(moved, pa.binary())], names=["lab", "ids", "x"])

        # one model without labels; with labels the planner broadcasts what its measured size allows
        trees = F.broadcast(trees) if self.label_table is None else trees
        return blocks.join(trees, "lab").select("lab", "ids", "x", "feature", "cut", "value").mapInArrow(step, BLOCKS)


class Written:
    """Trees on their way to a table: held on the driver up to half of GROUP_BYTES, then appended."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, trees: Trees, tree: int) -> None:
        for i, (lab, level) in enumerate(trees.models):
            self.rows.append((lab, level, tree, trees.feature[i].tobytes(), trees.cut[i].tobytes(), trees.value[i].tobytes()))
        self.bytes += trees.feature.nbytes + trees.cut.nbytes + trees.value.nbytes
        if self.bytes > GROUP_BYTES // 2:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            table = pa.table(columns, names=["lab", "level", "tree", "feature", "cut", "value"])
            self.spark.createDataFrame(table).write.mode("append").parquet(self.path)
        self.rows, self.bytes = [], 0

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema("lab int, level int, tree int, feature binary, cut binary, value binary").parquet(self.path)


def numbered_labels(dist: DataFrame) -> DataFrame:
    """(label, lab, prob, low, high) of (label, n, prob): numbers from 0 and the share of [0, 1) of each label.

    Labels are numbered in parts by their hash, so no task sees them all but for the sums of the parts.
    """
    part = dist.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(LABEL_PARTS)))
    inside = W.partitionBy("_part").orderBy("label")
    own = part.select("label", "prob", "_part", F.row_number().over(inside).alias("_i"), F.sum("prob").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_upto"))
    sums = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("prob").alias("_p"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # LABEL_PARTS rows at most
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("_p").over(before), F.lit(0.0)).alias("_low"))
    high = F.col("_low") + F.col("_upto")
    return own.join(F.broadcast(starts), "_part").select(
        "label", (F.col("_from") + F.col("_i") - 1).cast("int").alias("lab"), "prob", (high - F.col("prob")).alias("low"), high.alias("high")
    )


def drawn_labels(rows: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """``rows`` (id, ...) with ``lab``, drawn with the labels' probabilities: joined by cells of [0, 1).

    What rounding leaves between two shares or beyond the last falls to the label below.
    """
    cell = lambda c: F.least(F.floor(c * LABEL_CELLS), F.lit(LABEL_CELLS - 1)).cast("int")
    following = F.coalesce(F.lead("low").over(W.partitionBy("cell").orderBy("low")), F.lit(2.0))
    spread = labels.select("lab", "low", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    ranges = spread.select("lab", "cell", "low", following.alias("next"), F.row_number().over(W.partitionBy("cell").orderBy("low")).alias("_first"))
    ranges = ranges.select("lab", "cell", F.when(F.col("_first") == 1, F.lit(-1.0)).otherwise(F.col("low")).alias("low"), "next")
    drawn = rows.withColumn("_u", key_uniform(["id"], seed)).withColumn("cell", cell(F.col("_u")))
    return drawn.join(ranges, "cell").where((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("next"))).drop("_u", "cell", "low", "next")


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(samples: DataFrame) -> DataFrame:
    """Generate once when several results read the same samples."""
    return cut_lineage(samples)
