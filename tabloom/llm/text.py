"""Words, lines and shingles of Arrow text columns as flat numpy arrays.

Texts stay one flat byte array with offsets; hashes are 64 bits from prefix sums, so no Python loop
runs over words. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20  # of text at a time; its arrays take some 50 times as much
_tables = np.random.RandomState(20240501)
BYTE_CODE = _tables.randint(0, 1 << 62, 256, dtype=np.int64).view(U) | U(1)
PLACE_CODE = _tables.randint(0, 1 << 62, 64, dtype=np.int64).view(U) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n, kept between calls."""
    if len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for key, step in (("up", BASE), ("down", INVERSE)):
                row = np.full(n, step, U)
                row[0] = 1
                _powers[key] = np.cumprod(row, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and the offsets between them."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def span_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string column."""
    size = end - start
    stop = np.cumsum(size)
    at = np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes()))


def word_spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of bytes not ``apart``) and how many each text has."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end, counts


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the number of words of each text; A-Z count as a-z with ``lower``."""
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    start, end, counts = word_spans(data, offsets)
    return span_hash(data, start, end), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles (with repeats) and how many each text has.

    A text with fewer words has its whole word sequence as one shingle, a text without words none.
    """
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    length = np.minimum(counts, width)[owner]
    with np.errstate(over="ignore"):
        total = PLACE_CODE[32 + length % 32] * U(3)
        for j in range(width):
            last = np.minimum(at + j, max(len(words) - 1, 0))
            total = total + np.where(j < length, mix(words[last] + PLACE_CODE[j]) if len(words) else U(0), U(0))
    return mix(total), sizes


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(column)
    values, sizes = shingles(words, counts, width)
    ends = np.cumsum(sizes)
    return [np.unique(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def fresh_names(docs: DataFrame, *names: str) -> Sequence[str]:
    """The names with as many underscores in front as keep them apart from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    mark = "__"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]
