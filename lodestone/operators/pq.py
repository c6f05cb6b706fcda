"""Product quantization: trained codebooks, one-byte codes, table-lookup search."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import to_matrix
from ..types import Metric, PqParams, check_dim, check_k
from . import storage
from .blocks import masked, score
from .exact import topk_maker
from .topk import PARTIAL, RESULT, best, pad


def kmeans(x: np.ndarray, codes: int, iters: int, rng: np.random.Generator) -> np.ndarray:
    """``codes`` centroids after exactly ``iters`` Lloyd steps in squared L2.

    Starts from distinct random rows. Ties go to the lower centroid; an empty
    cluster is reseeded with a random row.
    """
    c = x[rng.permutation(len(x))[:codes]].astype(np.float64)
    for _ in range(iters):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=codes)
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order].astype(np.float64), np.searchsorted(near[order], used), axis=0)
        c[used] = sums / counts[used, None]
        for k in np.flatnonzero(counts == 0):
            c[k] = x[rng.integers(len(x))]
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The lowest-numbered nearest centroid of every row."""
    out = np.empty(len(x), np.int64)
    c = c.astype(np.float64)
    for at in range(0, len(x), 4096):
        y = x[at : at + 4096].astype(np.float64)
        d = (c * c).sum(1)[None, :] - 2 * y @ c.T
        # the expanded form may turn exact ties around; settle near-ties with differences
        low = d.min(1, keepdims=True)
        pick = d.argmin(1)
        for i in np.flatnonzero(((d <= low + 1e-9 * (1 + np.abs(low))).sum(1) > 1)):
            pick[i] = ((c - y[i]) ** 2).sum(1).argmin()
        out[at : at + len(y)] = pick
    return out


class PqIndex:
    """Codes of (vec_id, embedding, ...) with codebooks trained on a sample."""

    def __init__(self, dim: int, metric: Metric = Metric.INNER_PRODUCT, params: PqParams | None = None):
        self.dim, self.metric, self.params = check_dim(dim), Metric.of(metric), params or PqParams()
        self.sub = self.params.sub_dim(self.dim)
        self.codebooks: np.ndarray | None = None  # m x codes x sub_dim: at most 256 rows a subspace
        self.codes: DataFrame | None = None

    # -- training
    @property
    def is_trained(self) -> bool:
        return self.codebooks is not None

    def train(self, vectors: DataFrame) -> PqIndex:
        """Trains the codebooks, always in L2, one task a subspace; drops codes added before.

        Where train_sample is below the rows, rows are drawn with replacement
        (Poisson counts, so their number is near train_sample).
        """
        p, dim, sub = self.params, self.dim, self.sub
        rows = vectors.count()
        want = p.sample_rows(rows)
        if want < rows:
            drawn = vectors.sample(withReplacement=True, fraction=want / rows, seed=p.seed)
            if drawn.count() < p.codes:  # a small draw that came out short
                drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(p.seed))).limit(max(want, p.codes))
        else:
            drawn = vectors

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                x = to_matrix(d["embedding"], dim)
                if len(x):
                    parts = x.reshape(len(x), p.m, sub)
                    yield pd.DataFrame({"sub": np.arange(p.m), "ids": [d["vec_id"].to_numpy(np.int64).tobytes()] * p.m, "xs": [np.ascontiguousarray(parts[:, j]).tobytes() for j in range(p.m)]})

        def fit(d: pd.DataFrame) -> pd.DataFrame:
            j = int(d["sub"].iloc[0])
            ids = np.frombuffer(b"".join(d["ids"]), np.int64)
            x = np.frombuffer(b"".join(d["xs"]), np.float32).reshape(-1, sub)
            x = x[np.argsort(ids, kind="stable")]  # group order isn't given
            c = kmeans(x, p.codes, p.train_iters, np.random.default_rng([p.seed, j]))
            return pd.DataFrame({"sub": [j], "c": [c.tobytes()]})

        got = drawn.select("vec_id", "embedding").mapInPandas(split, "sub int, ids binary, xs binary").groupBy("sub").applyInPandas(fit, "sub int, c binary").orderBy("sub").collect()
        self.codebooks = np.stack([np.frombuffer(bytes(r["c"]), np.float32).reshape(p.codes, sub) for r in got])
        self.codes = None
        return self

    def use_codebooks(self, codebooks: np.ndarray) -> PqIndex:
        """Takes given codebooks (m x codes x sub_dim) in place of training."""
        c = np.asarray(codebooks, np.float32)
        if c.shape != (self.params.m, self.params.codes, self.sub) or not np.isfinite(c).all():
            raise ValueError(f"codebooks must be finite and of shape {(self.params.m, self.params.codes, self.sub)}")
        self.codebooks, self.codes = c, None
        return self

    def _trained(self) -> np.ndarray:
        if self.codebooks is None:
            raise ValueError("the index isn't trained")
        return self.codebooks

    # -- encoding
    def encode(self, vectors: DataFrame) -> DataFrame:
        """Adds ``code`` (m bytes) to (vec_id, embedding, ...); other columns are kept, embedding is dropped."""
        books, dim, p, sub = self._trained(), self.dim, self.params, self.sub
        kept = [f for f in vectors.schema.fields if f.name not in ("embedding", "code")]
        from pyspark.sql.types import BinaryType, StructField, StructType

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                x = to_matrix(d["embedding"], dim).reshape(-1, p.m, sub)
                code = np.stack([nearest(x[:, j], books[j]) for j in range(p.m)], axis=1).astype(np.uint8)
                yield d[[f.name for f in kept]].assign(code=[r.tobytes() for r in code])

        return vectors.mapInPandas(run, StructType([*kept, StructField("code", BinaryType())]))

    def add(self, vectors: DataFrame) -> PqIndex:
        fresh = self.encode(vectors)
        self.codes = fresh if self.codes is None else self.codes.unionByName(fresh, allowMissingColumns=True)
        return self

    # -- searching
    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x m x codes partial keys."""
        books = self._trained().astype(np.float64)
        x = q.astype(np.float64).reshape(len(q), self.params.m, 1, self.sub)
        if self.metric is Metric.L2:
            return ((x - books[None]) ** 2).sum(-1)
        return -(x * books[None]).sum(-1)

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, mask: DataFrame | None = None, padded: bool = False, absent: str = "error") -> DataFrame:
        """As ExactIndex.search, over the codes.

        A vector's key is the sum of its entries in the query's tables, which is the key
        of its decoded form; decoded batches go through one matrix product, much faster
        than looking entries up.
        """
        self._trained()
        check_k(k)
        if self.codes is None:
            raise ValueError("the index is empty: add vectors first")
        m, dim, books = self.params.m, self.dim, self._trained()

        def decoded(d: pd.DataFrame) -> np.ndarray:
            code = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(-1, m)
            return books[np.arange(m), code].reshape(-1, dim)

        if k:
            found = best(score(masked(self.codes, where, mask, absent).select("vec_id", "code"), queries, dim, topk_maker(k, self.metric, decoded), PARTIAL, pack=False), k, self.metric)
        else:
            found = queries.sparkSession.createDataFrame([], RESULT)
        return pad(found, queries, k, self.metric) if padded else found

    def search_reranked(self, queries: DataFrame, vectors: DataFrame, k: int = 10, factor: int = 4, **filters) -> DataFrame:
        """Extension: the k best by exact score of the factor * k best by code."""
        from ..functions.vectors import key

        near = self.search(queries, k * factor, **filters).select("query_id", "vec_id")
        x = near.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", "query"), "query_id")
        return best(x.select("query_id", "vec_id", key(F.col("query"), F.col("embedding"), self.metric).alias("key")), k, self.metric)

    # -- introspection
    @property
    def size(self) -> int:
        return 0 if self.codes is None else self.codes.count()

    def __len__(self) -> int:
        return self.size

    @property
    def memory_bytes(self) -> int:
        books = 0 if self.codebooks is None else self.codebooks.size * 4
        return self.size * self.params.m + books

    @property
    def raw_bytes(self) -> int:
        return self.size * self.dim * 4

    @property
    def compression_ratio(self) -> float:
        return self.raw_bytes / self.memory_bytes if self.size else 0.0

    def codebook_table(self, spark: SparkSession) -> DataFrame:
        """(sub, code, centroid)."""
        c = self._trained()
        rows = [(j, i, [float(v) for v in c[j, i]]) for j in range(c.shape[0]) for i in range(c.shape[1])]
        return spark.createDataFrame(rows, "sub int, code int, centroid array<float>")

    # -- persistence
    def save(self, path: str) -> None:
        self._trained()
        if self.codes is None:
            raise ValueError("the index is empty")
        spark = self.codes.sparkSession
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.codebook_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
        storage.write_json(spark, f"{path}/index.json", json.dumps({"kind": "pq", "dim": self.dim, "metric": self.metric.value, **asdict(self.params)}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PqIndex:
        """m and nbits are restored; training parameters go back to their defaults."""
        meta = storage.read_index(spark, path, "pq")
        index = cls(meta["dim"], Metric.of(meta["metric"]), PqParams(m=meta["m"], nbits=meta["nbits"]))
        rows = spark.read.parquet(f"{path}/codebooks").orderBy("sub", "code").collect()
        index.use_codebooks(np.array([r["centroid"] for r in rows], np.float32).reshape(meta["m"], 1 << meta["nbits"], -1))
        index.codes = spark.read.parquet(f"{path}/codes")
        return index
