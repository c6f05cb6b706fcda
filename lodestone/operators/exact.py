"""Exact (flat) search over a DataFrame of vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import check_array, exact_keys, key, keys_matrix, literal, natural, require_valid, to_matrix
from ..types import Metric, check_dim, check_k
from . import storage
from .blocks import collected, masked, score
from .topk import PARTIAL, RESULT, best, pad, screen, single, trim_rows

#: Queries that search_columns takes: they become part of the plan.
COLUMN_QUERIES = 256


class ExactIndex:
    """An index over (vec_id, embedding, ...).

    Rows are checked when they are searched: a null, wrongly sized or non-finite
    vector fails the job and is never dropped. Nothing is copied on ``add``.
    """

    def __init__(self, dim: int, metric: Metric = Metric.INNER_PRODUCT, vectors: DataFrame | None = None):
        self.dim, self.metric = check_dim(dim), Metric.of(metric)
        self.vectors = vectors

    # -- building
    def add(self, vectors: DataFrame) -> ExactIndex:
        """Appends rows that have ids of their own."""
        self.vectors = vectors if self.vectors is None else self.vectors.unionByName(vectors, allowMissingColumns=True)
        return self

    def add_array(self, spark: SparkSession, x: np.ndarray) -> ExactIndex:
        """Appends matrix rows under the next positions as ids."""
        x = check_array(x, self.dim)
        start = self.size
        df = pd.DataFrame({"vec_id": np.arange(start, start + len(x)), "embedding": [v.tolist() for v in x]})
        return self.add(spark.createDataFrame(df, "vec_id long, embedding array<float>"))

    def append(self, vectors: DataFrame, order_by: str) -> ExactIndex:
        """Appends rows under dense new ids that follow on from the present ones, in ``order_by`` order."""
        from ..sources.corpus import dense_ids

        fresh = dense_ids(vectors.drop("vec_id"), order_by, "vec_id", start=self.size)
        return self.add(fresh)

    # -- introspection
    @property
    def size(self) -> int:
        return 0 if self.vectors is None else self.vectors.count()

    def __len__(self) -> int:
        return self.size

    @property
    def memory_bytes(self) -> int:
        return self.size * self.dim * 4

    # -- searching
    def _base(self, where: Column | None, mask: DataFrame | None, absent: str = "error") -> DataFrame:
        if self.vectors is None:
            raise ValueError("the index is empty: add vectors first")
        return masked(self.vectors, where, mask, absent).select("vec_id", "embedding")

    def search_one(self, query: list[float] | np.ndarray, k: int = 10, where: Column | None = None, mask: DataFrame | None = None) -> DataFrame:
        """The k best for one query vector, as a column plan that ends in a take of k ordered rows."""
        q = check_array(np.asarray(query), self.dim, "query")[0]
        base = require_valid(self._base(where, mask), "embedding", self.dim)
        return single(base.select("vec_id", key(F.col("embedding"), literal(q), self.metric).alias("key")), k, self.metric)

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, mask: DataFrame | None = None, padded: bool = False, absent: str = "error") -> DataFrame:
        """(query_id, rank, vec_id, score) for (query_id, query).

        Each task scores its Arrow batches as matrix products and keeps k rows a
        query, which are merged by (key, vec_id). The predicate or mask (see
        blocks.masked) is applied before any distance. k 0 gives no rows. Large
        query sets are dealt to a grid in the cluster (see blocks.score), so neither
        the driver nor the plan grows with them.
        """
        if not check_k(k):
            found = queries.sparkSession.createDataFrame([], RESULT)
        else:
            found = best(score(self._base(where, mask, absent), queries, self.dim, topk_maker(k, self.metric, reader(self.dim)), PARTIAL), k, self.metric)
        return pad(found, queries, k, self.metric) if padded else found

    def search_columns(self, queries: DataFrame, k: int = 10, where: Column | None = None, mask: DataFrame | None = None) -> DataFrame:
        """As ``search``, for at most COLUMN_QUERIES queries, wholly in column expressions.

        The queries are one array literal that every vector is scored against, so
        there is no join.
        """
        if queries.count() > COLUMN_QUERIES:
            raise ValueError(f"search_columns takes at most {COLUMN_QUERIES} queries; use search")
        ids, q = collected(queries, self.dim)
        base = require_valid(self._base(where, mask), "embedding", self.dim)
        block = F.array(*[F.struct(F.lit(int(i)).cast("long").alias("query_id"), literal(v).alias("query")) for i, v in zip(ids, q)])
        pairs = base.select("vec_id", "embedding", F.explode(block).alias("b"))
        return best(pairs.select("b.query_id", "vec_id", key(F.col("b.query"), F.col("embedding"), self.metric).alias("key")), k, self.metric)

    def within(self, queries: DataFrame, radius: float, where: Column | None = None, mask: DataFrame | None = None) -> DataFrame:
        """Extension: all vectors at a distance (L2) of at most, or with an inner product of at least, ``radius``."""
        limit = radius * radius if self.metric is Metric.L2 else -radius
        metric, dim = self.metric, self.dim

        def make(ids: np.ndarray, q: np.ndarray):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for d in batches:
                    x = to_matrix(d["embedding"], dim)
                    i, j = np.nonzero(keys_matrix(q, x, metric) <= limit + 1e-9 * max(1.0, abs(limit)))
                    e = exact_keys(q[i], x[j], metric)
                    ok = e <= limit
                    yield pd.DataFrame({"query_id": ids[i[ok]], "vec_id": d["vec_id"].to_numpy(np.int64)[j[ok]], "key": e[ok]})

            return run

        out = score(self._base(where, mask), queries, dim, make, PARTIAL)
        w = W.partitionBy("query_id").orderBy("key", "vec_id")
        return out.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", natural(F.col("key"), metric).alias("score"))

    # -- persistence
    def save(self, path: str) -> None:
        if self.vectors is None:
            raise ValueError("the index is empty")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        storage.write_json(self.vectors.sparkSession, f"{path}/index.json", json.dumps({"kind": "exact", "dim": self.dim, "metric": self.metric.value}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExactIndex:
        meta = storage.read_index(spark, path, "exact")
        return cls(meta["dim"], Metric.of(meta["metric"]), spark.read.parquet(f"{path}/vectors"))


def reader(dim: int):
    """The matrix of a batch of (vec_id, embedding)."""
    return lambda d: to_matrix(d["embedding"], dim)


def topk_maker(k: int, metric: Metric, read):
    """For blocks.score: keeps the k best of every query over all batches of a partition;
    ``read`` gives the matrix of a batch."""

    def make(ids: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            row, vec, keep = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for d in batches:
                if not len(d):
                    continue
                x, v = read(d), d["vec_id"].to_numpy(np.int64)
                for at in range(0, len(x), 4096):
                    y, w = x[at : at + 4096], v[at : at + 4096]
                    for a in range(0, len(q), 1024):
                        i, j = screen(q[a : a + 1024], y, metric, k)
                        e = exact_keys(q[a + i], y[j], metric)
                        row, vec, keep = np.append(row, a + i), np.append(vec, w[j]), np.append(keep, e)
                    top = trim_rows(row, keep, vec, k)
                    row, vec, keep = row[top], vec[top], keep[top]
            yield pd.DataFrame({"query_id": ids[row], "vec_id": vec, "key": keep})

        return run

    return make
