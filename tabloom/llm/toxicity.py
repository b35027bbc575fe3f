"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the places that its words, word pairs and pairs with one or two words
between hash to; a feature counts once. FTRL-proximal keeps two sums for each place, has a learning
rate of its own for each and sets weak weights to exactly zero (L1), so the trained model is a short
list of places and weights that is shipped with the scoring tasks.

Training uses a bounded sample of the labelled rows, ``SAMPLE`` of them at most by the hash of their
id, split into shards by another hash. In each round every shard, a task, runs twice over its rows
from the common state, and the mean of the states is the next one. A state is 2**20 places of eight
bytes and there are four shards, whatever the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import text as tx
from tabloom.session import scratch_root

BITS = 20
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 3
PASSES = 2  # of a shard in a round
WORK_BYTES = 1 << 20  # of text at a time; features take some 50 times as much
U = np.uint64
PLAIN = tx.LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20  # punctuation parts words


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    rare: float = 4.0  # weight of a toxic text, of which there are few


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every n-gram and skip-gram, with repeats."""
    data, offsets = tx.flat(column)
    data = PLAIN[data]
    start, end, counts = tx.word_spans(data, offsets)
    words = tx.span_hash(data, start, end)
    row = np.repeat(np.arange(len(counts)), counts)
    rows, places = [row], [tx.mix(words + tx.PLACE_CODE[8])]
    with np.errstate(over="ignore"):
        for step in (1, 2, 3):
            together = np.flatnonzero(row[:-step] == row[step:]) if len(row) > step else np.zeros(0, np.int64)
            rows.append(row[together])
            places.append(tx.mix(words[together] * tx.PLACE_CODE[9] + tx.mix(words[together + step] + tx.PLACE_CODE[9 + step])))
    return np.concatenate(rows), (np.concatenate(places) >> U(64 - BITS)).astype(np.int64)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int) -> DataFrame:
    """(shard, y, places) of the sampled labelled texts; an id counts once, toxic if any label says so."""
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "__id")
    # an id that repeats trains with its first text only, so the bound holds for texts too
    rows = rows.groupBy("__id", "y").agg(F.min("text").alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(SHARDS)).cast("int").alias("shard"), "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.pieces(batch, "text", WORK_BYTES):
                row, place = features(part.column("text"))
                both = np.unique(row << BITS | place)
                ends = np.searchsorted(both >> BITS, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("y"), lists], names=["shard", "y", "places"])

    path = f"{scratch_root(docs.sparkSession)}/{uuid.uuid4().hex}"
    rows.mapInArrow(run, "shard int, y int, places array<int>").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema("y int, places array<int>, shard int").parquet(path)


def weights_of(z: np.ndarray, n: np.ndarray, rates: Rates) -> np.ndarray:
    slope = (rates.beta + np.sqrt(n)) / rates.alpha + rates.l2
    return np.where(np.abs(z) <= rates.l1, 0.0, (np.sign(z) * rates.l1 - z) / slope)


def one_pass(z: np.ndarray, n: np.ndarray, bias: float, rows: list[tuple[int, np.ndarray]], rates: Rates) -> float:
    """FTRL-proximal over ``rows`` (y, places) in turn, changing z and n; returns the bias."""
    seen = 0.0
    for y, places in rows:
        zs, ns = z[places], n[places]
        w = weights_of(zs, ns, rates)
        p = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
        g = (p - y) * (rates.rare if y else 1.0)
        grown = ns + g * g
        z[places] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / rates.alpha * w
        n[places] = grown
        seen += g * g
        bias -= rates.alpha / (rates.beta + np.sqrt(seen)) * g
    return bias


@dataclass(frozen=True)
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float


def train(rows: DataFrame, rounds: int = ROUNDS, rates: Rates | None = None) -> Model:
    """The model of training rows; without any, a model that scores 0.1 everywhere."""
    rates = rates or Rates()
    size = 1 << BITS
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    total = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    share = ((total[1] or 0) + 1) / (total[0] + 10)
    bias = float(np.log(share / (1 - share)))
    shards = [rows.filter(F.col("shard") == s).coalesce(1) for s in range(SHARDS)]  # read from their own folders
    for _ in range(rounds if total[0] else 0):

        def shard_passes(batches: Iterator[pa.RecordBatch], state=(z, n, bias)) -> Iterator[pa.RecordBatch]:
            # SAMPLE / SHARDS texts or so
            texts = [
                (y, p.values.to_numpy())
                for b in batches
                for y, p in zip(b.column("y").to_pylist(), b.column("places"), strict=True)
            ]
            if not texts:
                return
            # an order that depends on the texts alone
            texts.sort(key=lambda t: (int(t[1].sum(dtype=np.int64)) * 2654435761 % 4294967291, len(t[1])))
            own_z, own_n, own_bias = state[0].astype(np.float64), state[1].astype(np.float64), state[2]
            for _ in range(PASSES):
                own_bias = one_pass(own_z, own_n, own_bias, texts, rates)
            out = {"z": [own_z.astype("<f4").tobytes()], "n": [own_n.astype("<f4").tobytes()], "bias": [own_bias]}
            yield pa.RecordBatch.from_pydict(out, pa.schema([("z", pa.binary()), ("n", pa.binary()), ("bias", pa.float64())]))

        states = reduce(DataFrame.union, shards).mapInArrow(shard_passes, "z binary, n binary, bias double").collect()
        z, n = (np.mean([np.frombuffer(r[c], "<f4") for r in states], axis=0) for c in "zn")
        bias = float(np.mean([r["bias"] for r in states]))
    w = weights_of(z, n, rates)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every row; a null or empty text has the score of no feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS)
        weight[model.places] = model.weights
        for batch in batches:
            for part in tx.pieces(batch, "text", WORK_BYTES):
                row, place = features(part.column("text"))
                hit = weight[place] != 0
                both = np.unique(row[hit] << BITS | place[hit])
                sums = np.bincount(both >> BITS, weight[both & ((1 << BITS) - 1)], part.num_rows) + model.bias
                scores = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores)], names=["id", "score"])

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Labels are learnt only from ids whose crc32 (of the id as text) is not divisible by 5; rows with
    a null id or label teach nothing, and only texts are inputs of a score. Repeated rows get equal
    scores. A null id is not held out.
    """
    model = train(training_rows(docs, labels, id_col, text, label, sample))
    out = score(docs, model, id_col, text)
    return out.select(
        id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
