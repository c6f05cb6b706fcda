"""fvecs and ivecs files: rows of an int32 dimension and that many values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import to_matrix
from ..types import Metric
from . import files


def _read(spark: SparkSession, path: str, kind: str, chunk_rows: int) -> DataFrame:
    size = files.size(path)
    dim = int(np.frombuffer(files.read(path, 0, 4), "<i4")[0]) if size >= 4 else 0
    if size and (dim < 1 or size % (4 * (dim + 1))):
        raise ValueError(f"{path}: {size} bytes don't hold whole rows of dimension {dim}")
    rows = size // (4 * (dim + 1)) if size else 0
    parts = [(a, min(a + chunk_rows, rows)) for a in range(0, rows, chunk_rows)]
    dtype = np.dtype("<f4") if kind == "float" else np.dtype("<i4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for a, b in zip(d["a"], d["b"]):
                for at in range(a, b, 8192):
                    n = min(at + 8192, b) - at
                    raw = np.frombuffer(files.read(path, 4 * (dim + 1) * at, 4 * (dim + 1) * n), "<i4").reshape(n, dim + 1)
                    if (raw[:, 0] != dim).any():
                        raise ValueError(f"{path}: rows differ in dimension")
                    yield pd.DataFrame({"vec_id": np.arange(at, at + n), "embedding": list(np.ascontiguousarray(raw[:, 1:]).view(dtype))})

    ranges = spark.createDataFrame(parts or [(0, 0)], "a long, b long").repartition(max(1, len(parts)))
    return ranges.mapInPandas(run, f"vec_id long, embedding array<{kind}>")


def read_fvecs(spark: SparkSession, path: str, chunk_rows: int = 100_000) -> DataFrame:
    """(vec_id, embedding array<float>); tasks read ranges of rows, from any file system that all executors see."""
    return _read(spark, path, "float", chunk_rows)


def read_ivecs(spark: SparkSession, path: str, chunk_rows: int = 100_000) -> DataFrame:
    """(vec_id, embedding array<int>)."""
    return _read(spark, path, "int", chunk_rows)


def write_fvecs(vectors: DataFrame, path: str, dim: int) -> None:
    """Writes embeddings in vec_id order as one fvecs file: packed batches are streamed through
    the driver, one partition at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                x = to_matrix(d["embedding"], dim).view("<i4")
                yield pd.DataFrame({"x": [np.concatenate([np.full((len(x), 1), dim, "<i4"), x], axis=1).tobytes()]})

    f, p = files.resolve(path)
    with f.open_output_stream(p) as out:
        for r in vectors.select("vec_id", "embedding").orderBy("vec_id").select("embedding").mapInPandas(run, "x binary").toLocalIterator():
            out.write(bytes(r["x"]))


def write_vecs(path: str, x: np.ndarray) -> None:
    """Writes a matrix as fvecs (floats) or ivecs (integers)."""
    x = np.atleast_2d(x)
    y = x.astype("<f4").view("<i4") if x.dtype.kind == "f" else x.astype("<i4")
    f, p = files.resolve(path)
    with f.open_output_stream(p) as out:
        out.write(np.concatenate([np.full((len(y), 1), y.shape[1], "<i4"), y], axis=1).tobytes())


@dataclass
class AnnDataset:
    base: DataFrame
    queries: DataFrame
    ground_truth: DataFrame
    metric: Metric
    train: DataFrame | None = None
    name: str = ""


def load_sift(spark: SparkSession, folder: str, prefix: str = "sift") -> AnnDataset:
    """The base, query and ground-truth files of a benchmark folder (learn is optional), in L2."""
    p = lambda part, kind: f"{folder}/{prefix}_{part}.{kind}"
    for f in (p("base", "fvecs"), p("query", "fvecs"), p("groundtruth", "ivecs")):
        if not files.exists(f):
            raise OSError(f"missing {f}")
    learn = p("learn", "fvecs")
    queries = read_fvecs(spark, p("query", "fvecs")).withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    truth = read_ivecs(spark, p("groundtruth", "ivecs")).selectExpr("vec_id as query_id", "posexplode(embedding) as (rank, vec_id)").selectExpr("query_id", "rank + 1 as rank", "cast(vec_id as bigint) vec_id")
    return AnnDataset(read_fvecs(spark, p("base", "fvecs")), queries, truth, Metric.L2, read_fvecs(spark, learn) if files.exists(learn) else None, prefix)
