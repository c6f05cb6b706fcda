"""Vector kernels as column expressions (double precision) and as numpy batches.

Column kernels suit single queries and small data; batches go through numpy,
where a block of queries against a block of vectors is one matrix product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Metric, check_dim


def literal(v: list[float] | np.ndarray) -> Column:
    """An array<double> literal."""
    return F.array(*[F.lit(float(x)) for x in v])


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences; raises where the lengths differ, null where either is null."""
    return _fold(F.zip_with(*_same_length(a, b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products; raises where the lengths differ, null where either is null."""
    return _fold(F.zip_with(*_same_length(a, b), lambda x, y: x * y))


def _same_length(a: Column, b: Column) -> tuple[Column, Column]:
    a, b = doubles(a), doubles(b)
    # zip_with would fill the shorter side with nulls and the sum would silently be null
    ok = F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return ok, b


def key(a: Column, b: Column, metric: Metric) -> Column:
    """The ordering key, smaller is better: squared L2, or the negated inner product."""
    return squared_l2(a, b) if metric is Metric.L2 else -inner_product(a, b)


def natural(k: Column, metric: Metric) -> Column:
    """The reported score of a key: Euclidean distance, or inner product."""
    return F.sqrt(F.greatest(k, F.lit(0.0))) if metric is Metric.L2 else -k


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; all-zero vectors stay as they are."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def is_valid(v: Column, dim: int) -> Column:
    """Not null, ``dim`` elements, none of them null, NaN or infinite. Never null itself."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == check_dim(dim)) & ~bad, F.lit(False))


def require_valid(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """``df`` with a check that fails the job on the first invalid vector; none is dropped."""
    v = F.col(vec_col)
    why = F.concat(F.lit(f"{vec_col}: not a finite vector of {dim} elements: size "), F.coalesce(F.size(v).cast("string"), F.lit("null")))
    return df.withColumn(vec_col, F.when(is_valid(v, dim), v).otherwise(F.raise_error(why).cast(df.schema[vec_col].dataType)))


def check_array(x: np.ndarray, dim: int, what: str = "vectors") -> np.ndarray:
    """A float32 matrix of ``dim`` columns; wrong shapes and non-finite values raise ValueError.

    Strided and Fortran-ordered arrays are copied, not misread.
    """
    x = np.ascontiguousarray(np.atleast_2d(np.asarray(x, np.float32)))
    if x.ndim != 2 or x.shape[1] != dim:
        raise ValueError(f"{what}: expected {dim} columns, not shape {x.shape}")
    if not np.isfinite(x).all():
        raise ValueError(f"{what}: NaN or infinite values")
    return x


def to_matrix(cells, dim: int, what: str = "vectors") -> np.ndarray:
    """Array cells of a batch, or cells of float32 bytes, as a checked float32 matrix."""
    rows = list(cells)
    if rows and isinstance(rows[0], (bytes, bytearray)):
        if any(len(v) != 4 * dim for v in rows):
            raise ValueError(f"{what}: expected {dim} elements in every row")
        return check_array(np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim), dim, what)
    if any(v is None or len(v) != dim for v in rows):
        raise ValueError(f"{what}: expected {dim} elements in every row")
    x = np.array([np.asarray(v, np.float32) for v in rows], np.float32).reshape(len(rows), dim)
    return check_array(x, dim, what) if len(x) else x


def keys_matrix(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """Queries x vectors keys in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    dots = q @ x.T
    if metric is Metric.INNER_PRODUCT:
        return -dots
    return np.maximum((q * q).sum(1)[:, None] - 2 * dots + (x * x).sum(1)[None, :], 0.0)


def exact_keys(q: np.ndarray, x: np.ndarray, metric: Metric) -> np.ndarray:
    """Pairwise keys of equally long lists, without the cancellation of the matrix form."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric is Metric.INNER_PRODUCT:
        return -np.einsum("ij,ij->i", q, x)
    d = q - x
    return np.einsum("ij,ij->i", d, d)
