"""Generated vectors; every row follows from its number and the seed alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.hnsw import splitmix
from ..types import check_dim


def _rows(spark: SparkSession, n: int, dim: int, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``make``: row numbers -> matrix, one call a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ids = d["id"].to_numpy(np.int64)
            yield pd.DataFrame({"vec_id": ids, "embedding": list(make(ids))})

    check_dim(dim)
    return spark.range(n).mapInPandas(run, "vec_id long, embedding array<float>")


def _fractions(seed: int, ids: np.ndarray, n: int, bits: int) -> np.ndarray:
    """rows x n multiples of 2**-bits in 0 .. 1: the generator's outputs in row-major order."""
    if not len(ids):
        return np.empty((0, n))
    if (np.diff(ids) == 1).all():
        z = splitmix(seed, int(ids[0]) * n, len(ids) * n).reshape(len(ids), n)
    else:
        z = np.stack([splitmix(seed, int(i) * n, n) for i in ids])
    return (z >> np.uint64(64 - bits)).astype(np.float64) / float(1 << bits)


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Values uniform over -1..1."""
    return _rows(spark, n, dim, lambda ids: (_fractions(seed, ids, dim, 24) * 2 - 1).astype(np.float32))


def gaussian_unit(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Standard normal rows scaled to unit length (pairs of uniform values, Box and Muller)."""

    def make(ids: np.ndarray) -> np.ndarray:
        half = (dim + 1) // 2
        u = _fractions(seed, ids, 2 * half, 53)
        r, a = np.sqrt(-2 * np.log(1 - u[:, :half])), 2 * np.pi * u[:, half:]
        x = np.concatenate([r * np.cos(a), r * np.sin(a)], axis=1)[:, :dim]
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    return _rows(spark, n, dim, make)
