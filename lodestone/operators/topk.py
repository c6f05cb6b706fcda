"""Top-k per query: selection, merging and padding.

Results are long: (query_id, rank, vec_id, score), rank from 1. Ties go to the
smaller vec_id everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import keys_matrix, natural
from ..types import Metric, check_k

RESULT = "query_id long, rank int, vec_id long, score double"
PARTIAL = "query_id long, vec_id long, key double"


def best(candidates: DataFrame, k: int, metric: Metric) -> DataFrame:
    """The k candidates (query_id, vec_id, key) of least key of every query.

    Row numbers over (key, vec_id) with the limit pushed below the exchange, so
    every map task sends k rows a query at most.
    """
    w = W.partitionBy("query_id").orderBy("key", "vec_id")
    x = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= check_k(k))
    return x.select("query_id", "rank", "vec_id", natural(F.col("key"), metric).alias("score"))


def single(scored: DataFrame, k: int, metric: Metric, query_id: int = 0) -> DataFrame:
    """The k rows of (vec_id, key) of least key: a distributed take of k ordered rows."""
    x = scored.orderBy("key", "vec_id").limit(check_k(k))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("key", "vec_id")))  # k rows
    return x.select(F.lit(query_id).cast("long").alias("query_id"), "rank", "vec_id", natural(F.col("key"), metric).alias("score"))


def select_block(keys: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of each row's k least keys, ties to the smaller id."""
    n = keys.shape[1]
    if k <= 0 or n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if n > k:
        kth = np.partition(keys, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * np.maximum(1.0, np.abs(kth))  # all that rounding could tie with the k-th
        row, col = np.nonzero(keys <= (kth + slack)[:, None])
    else:
        row, col = np.nonzero(np.ones_like(keys, bool))
    return row, col


def screen(q: np.ndarray, x: np.ndarray, metric: Metric, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, column) of all pairs that can be among a query's k least keys.

    The keys are products in single precision, at twice the speed; pairs within the
    bound of its rounding error of the k-th are kept, for the caller to settle with exact keys.
    """
    if k <= 0 or not len(x) or not len(q):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    qn, xn = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((x.astype(np.float64) ** 2).sum(1))
    top = float(xn.max())
    if not np.isfinite((q @ x[:1].T)).all() or max(float(qn.max()), top) > 1e15:
        return select_block(keys_matrix(q, x, metric), np.arange(len(x)), k)  # squares near the limits of single precision
    keys = q @ x.T
    if metric is Metric.INNER_PRODUCT:
        np.negative(keys, out=keys)
    else:
        keys *= -2
        keys += (xn**2).astype(np.float32)
    if len(x) <= k:
        return np.nonzero(np.ones(keys.shape, bool))
    kth = np.partition(keys, k - 1, axis=1)[:, k - 1]
    # a product of d terms is off by at most about d eps |q| |x|; the norms' part by eps |x|^2
    slack = (2 * q.shape[1] * np.finfo(np.float32).eps * (qn * top + (top * top if metric is Metric.L2 else 0)) * 2).astype(np.float32)
    return np.nonzero(keys <= (kth + slack)[:, None])


def trim_rows(row: np.ndarray, key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (key, id) of every row number."""
    order = np.lexsort((ids, key, row))
    r = row[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[place < k]


def pad(results: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """Fills every query up to k rows with vec_id -1 and the metric's worst score."""
    places = queries.select("query_id").distinct()
    places = places.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")) if check_k(k) else places.select("query_id", F.lit(0).alias("rank")).limit(0)
    x = places.join(results, ["query_id", "rank"], "left")
    return x.select("query_id", "rank", F.coalesce("vec_id", F.lit(-1).cast("long")).alias("vec_id"), F.coalesce("score", F.lit(metric.pad_score)).alias("score"))


def wide(results: DataFrame) -> DataFrame:
    """(query_id, ids array, scores array), by rank: k entries at most a query."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))
    x = results.groupBy("query_id").agg(rows.alias("r"))
    return x.select("query_id", F.transform("r", lambda e: e["vec_id"]).alias("ids"), F.transform("r", lambda e: e["score"]).alias("scores"))
