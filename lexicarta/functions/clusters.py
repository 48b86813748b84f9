"""K-means on a bounded sample held by the driver, and vector columns of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(df: DataFrame, key: Column, count: int, wanted: int, seed: int = 0) -> DataFrame:
    """About ``wanted`` of ``count`` rows by a hash of ``key``, or all of fewer; no task sends more than its share."""
    share = F.lit(min(1 << 20, -(-(wanted << 20) // max(1, count))))
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < share)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre at the least distance from each row."""
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, dtype=np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most ``k`` centres of the rows; a centre that loses all its rows is drawn anew."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, centres)
        counts = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        held = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order].astype(np.float64), (np.cumsum(counts) - counts)[held], axis=0)
        centres[held] = sums / counts[held, None]
        lost = np.flatnonzero(counts == 0)
        centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
