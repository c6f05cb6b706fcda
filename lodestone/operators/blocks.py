"""Scoring a set of queries against a table of vectors, whatever the size of either.

A small query set goes to the tasks as it is and the table is scanned in place.
A large one never passes the driver: queries and vectors are dealt to the cells of
a grid in the cluster (every query group meets every split of the table once), each
cell is scored in a task of bounded size, and the cells' answers are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import to_matrix

#: Queries that are sent to the tasks of a scan; larger sets are dealt to a grid.
QUERY_BLOCK = 4096
#: Most queries and vectors of a grid cell: some 30 and 60 MB at 128 dimensions.
CELL_QUERIES, CELL_ROWS = 65_536, 131_072

#: (ids, matrix) of queries -> a batch function over the table's rows
Make = Callable[[np.ndarray, np.ndarray], Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]]


def collected(queries: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a query set that was counted before."""
    rows = queries.select("query_id", "query").orderBy("query_id").collect()
    return np.array([r[0] for r in rows], np.int64), to_matrix([r[1] for r in rows], dim, "queries")


def packed(df: DataFrame, id_col: str, vec_col: str, dim: int, what: str) -> DataFrame:
    """(id_col, x): checked float32 bytes in place of arrays, which cost far more on the way to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({id_col: d[id_col], "x": [v.tobytes() for v in to_matrix(d[vec_col], dim, what)]})

    return df.select(id_col, vec_col).mapInPandas(run, f"{id_col} long, x binary")


def score(base: DataFrame, queries: DataFrame, dim: int, make: Make, kind: str, pack: bool = True) -> DataFrame:
    """All answers of ``make`` for every query over all rows of ``base``.

    ``base``: (vec_id, embedding), packed here where it is shuffled, or any other
    columns that ``make`` reads (``pack`` False).
    """
    n = queries.count()
    if n <= QUERY_BLOCK:
        return base.mapInPandas(make(*collected(queries, dim)), kind)
    groups = -(-n // CELL_QUERIES)
    splits = -(-base.count() // CELL_ROWS) or 1
    q = packed(queries, "query_id", "query", dim, "queries").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    q = q.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    b = packed(base, "vec_id", "embedding", dim, "vectors").withColumnRenamed("x", "embedding") if pack else base
    b = b.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(splits)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(left["query_id"].to_numpy(), kind="stable")
        left = left.iloc[order]
        out = []
        for at in range(0, len(left), QUERY_BLOCK):  # bounds the matrices
            y = left.iloc[at : at + QUERY_BLOCK]
            run = make(y["query_id"].to_numpy(np.int64), to_matrix(y["x"], dim, "queries"))
            out += list(run(right.iloc[a : a + 10_000] for a in range(0, len(right), 10_000)))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")})

    return q.groupBy("_q", "_s").cogroup(b.groupBy("_q", "_s")).applyInPandas(cell, kind)


def masked(vectors: DataFrame, where: Column | None = None, mask: DataFrame | Sequence[bool] | np.ndarray | None = None, absent: str = "error") -> DataFrame:
    """The vectors that a predicate or a mask lets through.

    A mask is (vec_id, keep), or one flag a vector by position, i.e. for ids 0 .. n - 1.
    It must cover every vector: one whose id it lacks fails the job, and a list of
    another length than the table raises ValueError. With ``absent`` 'drop' ids
    that the mask lacks don't pass. Null flags don't pass; of repeated ids any true
    flag counts; ids without a vector are ignored.
    """
    if absent not in ("error", "drop"):
        raise ValueError("absent must be 'error' or 'drop'")
    if where is not None:
        vectors = vectors.where(where)
    if mask is None:
        return vectors
    if not isinstance(mask, DataFrame):
        flags, n = np.asarray(mask, bool).ravel(), vectors.count()
        if len(flags) != n:
            raise ValueError(f"the mask has {len(flags)} flags for {n} vectors")
        mask = vectors.sparkSession.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "keep": flags}), "vec_id long, keep boolean")
    if absent == "drop":
        return vectors.join(mask.where(F.col("keep")).select("vec_id").distinct(), "vec_id", "left_semi")
    flags = mask.groupBy("vec_id").agg(F.coalesce(F.max("keep"), F.lit(False)).alias("_keep"))
    missing = F.raise_error(F.concat(F.lit("the mask lacks the vector "), F.col("vec_id").cast("string"))).cast("boolean")
    return vectors.join(flags, "vec_id", "left").where(F.coalesce("_keep", missing)).drop("_keep")
