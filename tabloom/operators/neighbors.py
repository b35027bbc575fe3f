"""Nearest neighbours, neighbour distance and local outlier factor.

Exact search prunes with pivots: every location belongs to its nearest pivot, cells are cut
into blocks of bounded size by distance to the pivot, and the triangle inequality says which
blocks can still hold one of the k nearest locations of a query. Blocks of queries are gathered in a
bounded number of groups; a group keeps its running k nearest while the blocks it still needs pass by, compared as
matrices. A block travels once to a group and not once to a block, and a query gives k rows in all.
Rows at the same location are searched once, whatever their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import key_hash
from ..session import cut_lineage
from .features import as_matrix
from .joins import hot_keys, skew_safe_left_join
from .ranking import exact_quantiles

BLOCK_ROWS = 2048
PIVOTS = 1024  # cells of the first level; a cell's blocks are rings around its pivot and slices of those, as many as it needs
QUERY_CHUNK = 256
GROUPS = 48  # of queries: every location travels to at most as many, until a group would exceed GROUP_ROWS
GROUP_ROWS = 1 << 15  # most locations of a group of queries, about
RECALL = 0.95  # what the probing search aims at where the number of probes is left open
RECALL_ROWS = 512  # locations whose neighbours are searched by brute force to find that number


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared Euclidean or Chebyshev distances; the Euclidean form may carry rounding noise."""
    if metric == "chebyshev":
        return np.max(np.abs(a[:, None, :] - b[None, :, :]), axis=2)
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row-by-row distances without cancellation."""
    diff = a - b
    return np.max(np.abs(diff), axis=1) if metric == "chebyshev" else np.sqrt((diff * diff).sum(axis=1))


def _block_topk(
    q: np.ndarray, q_ids: np.ndarray, t: np.ndarray, t_ids: np.ndarray, k: int, metric: str, limit: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, target position, distance) of up to k nearest targets per query, self left out.

    Candidates are everything not clearly worse than the k-th rough distance; the kept
    distances are recomputed exactly, so ties are broken by id and not by rounding.
    """
    out_q, out_t, out_d = [], [], []
    for lo in range(0, len(q), QUERY_CHUNK):
        part, ids = q[lo : lo + QUERY_CHUNK], q_ids[lo : lo + QUERY_CHUNK]
        rough = _distances(part, t, metric)
        rough[ids[:, None] == t_ids[None, :]] = np.inf
        scale = 1e-9 * (1.0 + float(np.max(rough[np.isfinite(rough)], initial=0.0)))
        bound = None if limit is None else limit[lo : lo + QUERY_CHUNK]
        if t.shape[0] > k and (bound is None or np.isinf(bound).any()):
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(len(part), np.inf)
        if bound is not None:
            kth = np.minimum(kth, bound * bound if metric != "chebyshev" else bound)
        qi, ti = np.nonzero((rough <= kth[:, None] + scale) & np.isfinite(rough))
        if not len(qi):
            continue
        d = _exact(part[qi], t[ti], metric)
        order = np.lexsort((t_ids[ti], d, qi))
        qi, ti, d = qi[order], ti[order], d[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        keep = place < k
        out_q.append(qi[keep] + lo)
        out_t.append(ti[keep])
        out_d.append(d[keep])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_t), np.concatenate(out_d)


def _locations(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: representative id, copies, and its k+1 smallest ids.

    The row-number filter is pushed below the shuffle as a group limit, so a vector shared
    by a third of all rows still sends only k+1 ids per task.
    """
    place = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    few = points.withColumn("_p", place).where(F.col("_p") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))


def _assign(locations: DataFrame, pivots: np.ndarray, metric: str, id_type: str, probes: int) -> DataFrame:
    """Nearest pivot, the distance to it, and the ``probes`` nearest pivots."""
    probes = min(probes, len(pivots))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = as_matrix(pdf["vec"])
            cell, near = np.empty(len(x), dtype="int32"), []
            for lo in range(0, len(x), QUERY_CHUNK):
                d = _distances(x[lo : lo + QUERY_CHUNK], pivots, metric)
                cell[lo : lo + QUERY_CHUNK] = np.argmin(d, axis=1)
                near.append(np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(d), 0), int))
            pdf["cell"] = cell
            pdf["radius"] = _exact(x, pivots[cell], metric)
            pdf["near"] = list(np.vstack(near).astype("int32"))
            yield pdf

    return locations.mapInPandas(nearest, f"rep {id_type}, vec array<double>, cell int, radius double, near array<int>")


def _blocks(assigned: DataFrame, rings: int = 64) -> DataFrame:
    """Add ``block``: cell x distance ring x hash slice, none above about BLOCK_ROWS locations."""
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("far"))
    # a row per cell, and a row per cell and ring
    cuts = sizes.withColumn("rings", F.least(F.lit(rings), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int"))
    ringed = assigned.join(F.broadcast(cuts.select("cell", "far", "rings")), "cell").withColumn(
        "ring",
        F.least(
            F.col("rings") - 1,
            F.coalesce(F.floor(F.try_divide(F.col("radius"), F.col("far")) * F.col("rings")), F.lit(0)).cast("int"),
        ),
    )
    slices = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("slices"))
    sliced = ringed.join(F.broadcast(slices), ["cell", "ring"]).withColumn(
        "slice", F.pmod(key_hash(["rep"], 11), F.col("slices")).cast("int")
    )
    block = F.concat_ws(".", F.col("cell"), F.col("ring"), F.col("slice"))
    return cut_lineage(sliced.select("rep", "vec", "cell", "radius", "near", block.alias("block")))


def _vector_bytes(x: np.ndarray) -> bytes:
    """The matrix in single precision where that loses nothing; ``_vectors`` tells by the length."""
    small = x.astype(np.float32)
    return (small if (small == x).all() else x).tobytes()


def _vectors(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * dims else np.float64).reshape(n, dims).astype(np.float64)


def _packed(rows: DataFrame, id_type: str) -> DataFrame:
    """(block, cell, lo, hi, ids, vecs, near, visits): a row per block; blocks have at most about BLOCK_ROWS locations.

    ``near`` are the cells that each location probes, ``visits`` the distinct ones.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x, r = as_matrix(pdf["vec"]), pdf["radius"]
        near = np.array(pdf["near"].tolist(), dtype=np.int32)
        return pd.DataFrame(
            {
                "block": [pdf["block"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "lo": [r.min()], "hi": [r.max()], "ids": [pdf["rep"].to_numpy()],
                "vecs": [_vector_bytes(x)], "near": [near.tobytes()], "visits": [np.unique(near)],
            }
        )

    shape = f"block string, cell int, lo double, hi double, ids array<{id_type}>, vecs binary, near binary, visits array<int>"
    return rows.groupBy("block").applyInPandas(pack, shape)


def _nearest(best: list[np.ndarray], fresh: tuple[np.ndarray, ...], k: int) -> list[np.ndarray]:
    """The k first (query position, distance, target id) of each query of ``best`` and ``fresh`` together, sorted."""
    qi, d, ti = (np.concatenate(c) for c in zip(best, fresh))
    order = np.lexsort((ti, d, qi))
    qi, d, ti = qi[order], d[order], ti[order]
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    keep = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)])) < k
    return [qi[keep], d[keep], ti[keep]]


def _compared(packed: DataFrame, wanted: DataFrame, pairs: DataFrame, n: int, k: int, metric: str, dims: int, id_type: str, probing: bool) -> DataFrame:
    """(rep, nbr, dist, rk): the k nearest of each location among the blocks that ``pairs`` (source, target) names.

    ``wanted`` has the bound of each location of a block (source, bound). Blocks of queries form groups along their names, so
    that a group's blocks lie in few cells. A task reads the queries of a group, then one target block after the other.
    """
    groups = max(1, min(GROUPS, -(-8 * n // BLOCK_ROWS)), -(-n // GROUP_ROWS))
    # a row per block, without its vectors
    sizes = cut_lineage(packed.select(F.col("block").alias("source"), "cell", F.size("ids").alias("m")))
    upto = W.partitionBy(F.lit(0)).orderBy("cell", "source").rowsBetween(W.unboundedPreceding, -1)
    place = F.floor(F.coalesce(F.sum("m").over(upto), F.lit(0)) * groups / n).cast("int")
    member = cut_lineage(sizes.select("source", F.least(place, F.lit(groups - 1)).alias("grp")))
    asked = pairs.join(member, "source").groupBy("grp", "target").agg(F.collect_set("source").alias("sources"))
    none, no_bytes = F.lit(None), F.lit(None).cast("binary")
    queries = packed.withColumnRenamed("block", "source").join(member, "source").join(wanted, "source").select(
        "grp", F.lit(0).alias("kind"), F.col("source").alias("block"), "cell", "ids", "vecs", "near", "bound", none.cast("array<string>").alias("sources")
    )
    targets = packed.withColumnRenamed("block", "target").join(asked, "target").select(
        "grp", F.lit(1).alias("kind"), F.col("target").alias("block"), "cell", "ids", "vecs", no_bytes.alias("near"),
        none.cast("array<double>").alias("bound"), "sources",
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}

        def out() -> Iterator[pd.DataFrame]:
            for g in held.values():
                qi, d, ti = g["best"]
                if len(qi):
                    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
                    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)])) + 1
                    yield pd.DataFrame({"rep": g["ids"][qi], "nbr": ti, "dist": d, "rk": rank.astype("int32")})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.grp != now:
                    yield from out()
                    now, held = row.grp, {}
                ids = np.asarray(row.ids)
                x = _vectors(row.vecs, len(ids), dims)
                if row.kind == 0:
                    limit = np.full(len(ids), np.inf) if row.bound is None else np.asarray(row.bound, dtype=float)
                    near = np.frombuffer(row.near, np.int32).reshape(len(ids), -1) if probing else None
                    held[row.block] = {"ids": ids, "x": x, "limit": limit.copy(), "near": near, "best": [np.zeros(0, int), np.zeros(0), ids[:0]]}
                    continue
                for source in row.sources:
                    g = held[source]
                    some = np.arange(len(g["ids"])) if g["near"] is None else np.flatnonzero((g["near"] == row.cell).any(axis=1))
                    if not len(some):
                        continue
                    qi, ti, d = _block_topk(g["x"][some], g["ids"][some], x, ids, k, metric, g["limit"][some])
                    if len(qi):
                        g["best"] = _nearest(g["best"], (some[qi], d, ids[ti]), k)
                        at, dist, _ = g["best"]
                        # with k in hand, the farthest of them is the limit
                        counts = np.bincount(at, minlength=len(g["ids"]))
                        full = counts == k
                        g["limit"][full] = np.minimum(g["limit"][full], dist[np.cumsum(counts)[full] - 1])
        yield from out()

    work = queries.unionByName(targets).repartition(groups, "grp").sortWithinPartitions("grp", "kind")
    return work.mapInPandas(compare, f"rep {id_type}, nbr {id_type}, dist double, rk int")


def _fitted_probes(assigned: DataFrame, pivots: np.ndarray, k: int, metric: str, seed: int, id_type: str) -> int:
    """The fewest probes that find RECALL of the k nearest locations of RECALL_ROWS locations, searched by brute force among all."""
    chosen = assigned.select("rep", "vec").orderBy(key_hash(["rep"], seed + 7), "rep").limit(RECALL_ROWS).collect()
    ids, x = np.array([r["rep"] for r in chosen]), np.array([r["vec"] for r in chosen], dtype=float)
    shared = assigned.sparkSession.sparkContext.broadcast((ids, x))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        best, cells = [np.zeros(0, int), np.zeros(0), ids[:0]], {}
        for pdf in batches:
            t_ids, cell = pdf["rep"].to_numpy(), pdf["cell"].to_numpy()
            for lo in range(0, len(pdf), BLOCK_ROWS):
                own = slice(lo, lo + BLOCK_ROWS)
                qi, ti, d = _block_topk(x, ids, as_matrix(pdf["vec"].iloc[own]), t_ids[own], k, metric, None)
                cells |= zip(t_ids[own][ti].tolist(), cell[own][ti].tolist())
                best = _nearest(best, (qi, d, t_ids[own][ti]), k)
        yield pd.DataFrame({"at": best[0].astype("int32"), "dist": best[1], "nbr": best[2], "cell": np.array([cells[i] for i in best[2].tolist()], "int32")})

    found = assigned.select("rep", "vec", "cell").mapInPandas(compare, f"at int, dist double, nbr {id_type}, cell int")
    place = F.row_number().over(W.partitionBy("at").orderBy("dist", "nbr"))
    # at most RECALL_ROWS x k rows
    edges = found.withColumn("rk", place).where(F.col("rk") <= k).select("at", "cell").collect()
    if not edges:
        return len(pivots)
    at, cell = np.array([r["at"] for r in edges]), np.array([r["cell"] for r in edges])
    rank = np.argsort(np.argsort(_distances(x, pivots, metric), axis=1, kind="stable"), axis=1)
    return int(np.quantile(rank[at, cell], RECALL, method="higher")) + 1


def _search(
    locations: DataFrame, k: int, metric: str, seed: int, n: int, probes: int | None, id_type: str
) -> DataFrame:
    """(rep, nbr, dist, rk): up to k nearest other locations of every location; ``probes`` 0 fits their number, None is exact."""
    wanted = int(min(max(math.sqrt(n) / 4, 1), PIVOTS))
    chosen = locations.select("vec").orderBy(key_hash(["vec"], seed), "vec").limit(wanted).collect()
    pivots = np.array([r["vec"] for r in chosen], dtype=float)
    if probes is not None and wanted > 1:
        model = KMeans(k=wanted, seed=seed, maxIter=10, featuresCol="_v").fit(
            locations.select(array_to_vector("vec").alias("_v"))
        )
        pivots = np.array(model.clusterCenters())
    if probes == 0:
        homes = cut_lineage(_assign(locations.select("rep", "vec"), pivots, metric, id_type, 0))
        probes = _fitted_probes(homes, pivots, k, metric, seed, id_type)
    blocked = _blocks(_assign(locations.select("rep", "vec"), pivots, metric, id_type, probes or 0))
    dims = pivots.shape[1]
    if probes is not None:
        return _probing(blocked, k, metric, n, dims, id_type)
    return _pruning(blocked, pivots, k, metric, n, dims, id_type)


def _probing(blocked: DataFrame, k: int, metric: str, n: int, dims: int, id_type: str) -> DataFrame:
    """Every location visits the blocks of its own nearest cells."""
    packed = cut_lineage(_packed(blocked, id_type))
    visits = packed.select(F.col("block").alias("source"), F.explode("visits").alias("cell"))
    pairs = visits.join(packed.select(F.col("block").alias("target"), "cell"), "cell").select("source", "target")
    wanted = packed.select(F.col("block").alias("source"), F.lit(None).cast("array<double>").alias("bound"))
    return _compared(packed, wanted, pairs, n, k, metric, dims, id_type, True)


def _pruning(blocked: DataFrame, pivots: np.ndarray, k: int, metric: str, n: int, dims: int, id_type: str) -> DataFrame:
    """Every block visits the blocks that the triangle inequality cannot rule out for one of its locations.

    A block knows the distances of its locations to all pivots and says for each cell which distances to the
    cell's pivot are still of interest; a join by cell finds the blocks that reach into them. The driver keeps a
    number of locations and a radius for each pivot, and no table of blocks.
    """
    found = blocked.groupBy("cell").agg(F.max("radius").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    cells = np.array(sorted(r["cell"] for r in found))
    far = np.array([r["far"] for r in sorted(found, key=lambda r: r["cell"])])
    held = np.array([r["n"] for r in sorted(found, key=lambda r: r["cell"])])
    shared = blocked.sparkSession.sparkContext.broadcast((cells, far, held, pivots))
    packed = cut_lineage(_packed(blocked, id_type))
    need = min(k, n - 1)

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, far, held, pivots = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.asarray(row.ids)
                x = _vectors(row.vecs, len(ids), dims)
                to_pivot = np.column_stack([_exact(x, pivots[c][None, :], metric) for c in cells])
                bound = np.full(len(x), np.inf)
                if len(x) > need:
                    qi, _, d = _block_topk(x, ids, x, ids, need, metric, None)
                    counts = np.bincount(qi, minlength=len(x))
                    full = counts >= need
                    bound[full] = d[np.cumsum(counts)[full] - 1]
                # small block: walk cells by their farthest possible point until k others are covered
                for i in np.flatnonzero(np.isinf(bound)):
                    order = np.argsort(to_pivot[i] + far)
                    enough = np.cumsum(held[order]) >= need + 1
                    if enough.any():
                        bound[i] = (to_pivot[i] + far)[order[np.argmax(enough)]]
                slack = bound * (1 + 1e-12) + 1e-12
                inner, outer = (to_pivot - slack[:, None]), (to_pivot + slack[:, None])
                # of each cell the intervals of all locations, as few as they cover; a gap between them is no interest
                wanted = [(int(c), *span) for j, c in enumerate(cells) for span in _merged(inner[:, j], outer[:, j], far[j])]
                yield pd.DataFrame(
                    {"source": [row.block], "bound": [bound], "wanted": [[{"cell": c, "inner": a, "outer": b} for c, a, b in wanted]]}
                )

    wanted = packed.select("block", "ids", "vecs").mapInPandas(
        bounded, "source string, bound array<double>, wanted array<struct<cell:int,inner:double,outer:double>>"
    )
    wanted = cut_lineage(wanted)
    reach = wanted.select("source", F.inline("wanted")).join(packed.select(F.col("block").alias("target"), "cell", "lo", "hi"), "cell")
    pairs = reach.where((F.col("lo") <= F.col("outer")) & (F.col("inner") <= F.col("hi"))).select("source", "target").distinct()
    return _compared(packed, wanted.select("source", "bound"), pairs, n, k, metric, dims, id_type, False)


def _merged(inner: np.ndarray, outer: np.ndarray, far: float) -> list[tuple[float, float]]:
    """The union of the intervals [inner, outer] that reach into [0, far], as disjoint ones."""
    live = inner <= far
    order = np.argsort(inner[live])
    a, b = inner[live][order], np.maximum.accumulate(outer[live][order]) if live.any() else outer[live]
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, int)
    last = np.append(first[1:], len(a)) - 1 if len(first) else first
    return list(zip(a[first].tolist(), b[last].tolist()))


def _ids_at(dist: Column, ids: Column) -> Column:
    """An array of (dist, nbr), one for each of ``ids``."""
    return F.transform(ids, lambda i: F.struct(dist.alias("dist"), i.alias("nbr")))


def knn_graph(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    method: str = "exact",
    probes: int | None = None,
    metric: str = "euclidean",
    seed: int = 42,
) -> DataFrame:
    """(id, nbr, dist, rk): the k nearest other rows, ties by neighbour id.

    ``method="ivf"`` visits only the ``probes`` nearest KMeans cells of each location and
    may miss neighbours; "exact" never does. Without ``probes`` their number is the smallest that
    finds RECALL of the true neighbours of a sample.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    points = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    locations = cut_lineage(_locations(points, k))
    n = locations.count()
    if n == 0:
        return points.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"), F.lit(1).alias("rk")).limit(0)
    reps = _search(locations, k, metric, seed, n, (probes or 0) if method == "ivf" else None, id_type)

    if locations.where(F.size("ids") > 1).limit(1).count() == 0:
        # no two rows share a location, so locations are rows
        return reps.select(F.col("rep").alias("id"), "nbr", "dist", "rk")

    # the k+1 nearest ids of a location: its own ids at distance 0, then ids of near locations
    reps = cut_lineage(reps)  # the hot keys and the join read it
    ids = locations.select("rep", "ids")
    hot_reps = hot_keys(reps.select(F.col("nbr").alias("rep")), ["rep"])
    near = skew_safe_left_join(
        reps.select(F.col("rep").alias("at"), F.col("nbr").alias("rep"), "dist"), ids, ["rep"], ["at", "rep"], hot_reps
    ).groupBy("at").agg(F.collect_list(F.struct("dist", "ids")).alias("others"))
    placed = locations.select(F.col("rep").alias("at"), "vec", "ids").join(near, "at", "left")
    own = _ids_at(F.lit(0.0), F.col("ids"))
    # k + 1 copies leave no place for others; else up to k others with k + 1 ids each
    far = F.when(F.size("ids") <= k, F.flatten(F.transform("others", lambda e: _ids_at(e["dist"], e["ids"]))))
    by_vec = placed.select("vec", F.slice(F.array_sort(F.concat(own, F.coalesce(far, F.slice(own, 1, 0)))), 1, k + 1).alias("near"))
    # rows find their location by vector; copies of one vector are served from a small broadcast
    rows = skew_safe_left_join(points, by_vec, ["vec"], ["id"], hot_keys(points, ["vec"]))
    others = F.slice(F.filter("near", lambda e: e["nbr"] != F.col("id")), 1, k)
    edges = rows.select("id", F.posexplode(others).alias("pos", "e"))
    return edges.select("id", F.col("e.nbr").alias("nbr"), F.col("e.dist").alias("dist"), (F.col("pos") + 1).alias("rk"))


def knn_distance(
    df: DataFrame, id_col: str, vec_col: str = "features", k: int = 5, min_rows: int = 100, method: str = "exact"
) -> DataFrame:
    """(id, knn_distance): mean distance to the min(k, n-1) nearest rows; empty unless n exceeds ``min_rows``."""
    n = df.count()
    base = df if n > min_rows else df.limit(0)
    edges = knn_graph(base, id_col, vec_col, min(k, max(n - 1, 1)), method)
    return edges.groupBy(F.col("id").alias(id_col)).agg(F.avg("dist").alias("knn_distance"))


def lof_from_edges(edges: DataFrame) -> DataFrame:
    """(id, lof) from a kNN edge list."""
    nodes = edges.groupBy("id").agg(F.max("dist").alias("kdist"))
    by_nbr = ["nbr"]
    hubs = hot_keys(edges, by_nbr)
    reach = skew_safe_left_join(
        edges.select("id", "nbr", "dist"), nodes.withColumnRenamed("id", "nbr"), by_nbr, ["id", "nbr"], hubs
    )
    # fixed value: the small constant keeps density finite among exact copies
    density = reach.groupBy("id").agg(
        (1.0 / (F.avg(F.greatest("kdist", "dist")) + F.lit(1e-10))).alias("lrd")
    )
    around = skew_safe_left_join(
        edges.select("id", "nbr"), density.select(F.col("id").alias("nbr"), F.col("lrd").alias("nbr_lrd")),
        by_nbr, ["id", "nbr"], hubs,
    )
    mean_around = around.groupBy("id").agg(F.avg("nbr_lrd").alias("nbr_lrd"))
    return mean_around.join(density, "id").select("id", (F.col("nbr_lrd") / F.col("lrd")).alias("lof"))


def local_outlier_factor(
    df: DataFrame,
    id_col: str,
    vec_col: str = "features",
    k: int = 20,
    contamination: float = 0.1,
    method: str = "exact",
) -> DataFrame:
    """(id, local_outlier_factor, local_outlier_factor_outlier); flags the top ``contamination`` share."""
    n = df.count()
    edges = cut_lineage(knn_graph(df, id_col, vec_col, min(k, max(n - 1, 1)), method))
    scores = cut_lineage(lof_from_edges(edges))
    edge = exact_quantiles(scores, ["lof"], [1.0 - contamination]).first()
    limit = edge["quantile"] if edge else 0.0
    return scores.select(
        F.col("id").alias(id_col),
        F.col("lof").alias("local_outlier_factor"),
        (F.col("lof") > F.lit(limit)).cast("int").alias("local_outlier_factor_outlier"),
    )
