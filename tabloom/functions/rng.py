"""Randomness that depends on keys only, never on the partition a row sits in."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(keys: Sequence[str | Column], seed: int) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    # second round: xxhash64 of a single small integer is not well mixed across seeds
    return F.xxhash64(F.xxhash64(*cols, F.lit(seed)), F.lit(seed))


def key_uniform(keys: Sequence[str | Column], seed: int) -> Column:
    """Uniform in [0, 1) from the row key, with 52 random bits."""
    return F.shiftrightunsigned(key_hash(keys, seed), 12).cast("double") / F.lit(float(1 << 52))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def normals(base: np.ndarray, rep: int, dims: int) -> np.ndarray:
    """Standard normals of shape (len(base), dims), a pure function of (base, rep, dim)."""
    with np.errstate(over="ignore"):
        lane = np.arange(2 * dims, dtype=np.uint64)[None, :]
        start = mix64(base.astype(np.int64).view(np.uint64) + np.uint64(rep) * np.uint64(0xD1B54A32D192ED03))
        bits = mix64(start[:, None] + lane * np.uint64(0x2545F4914F6CDD1D))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    radius = np.sqrt(-2.0 * np.log(u[:, :dims]))
    return radius * np.cos(2.0 * np.pi * u[:, dims:])
