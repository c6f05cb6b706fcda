"""The k most similar vectors of every vector, by multi-index hashing (see codes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import slots, stage
from .codes import MultiIndex, bucketed, pack_floats, unit, unpack_group, valid_vector
from .common import latest

TABLES = 20


def distinct_vectors(vectors: DataFrame, dim: int, id_col: str, vec_col: str, ts_col: str | None) -> tuple[DataFrame, DataFrame]:
    """(packed, copies) of the valid current vectors.

    packed(id, x): one row per distinct vector under its smallest id. copies(rep,
    id): ids of vectors that are repeated exactly, rep itself among them.
    """
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).alias("id"), (F.col(ts_col) if ts_col else F.lit(0)).cast("timestamp").alias("ts"), F.xxhash64(v).alias("h"), F.when(valid_vector(v, dim), v).alias("v"))
    rows = latest(rows.mapInPandas(pack_floats, "id long, ts timestamp, h long, x binary"), "id", "ts")
    rows = stage(rows.where("x is not null").select("id", "x"), "vectors")
    # copies are found by digest, in two steps so that a hot vector is counted before the shuffle
    digest = rows.select("id", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"))
    reps = digest.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "rep")
    copies = stage(digest.join(reps, ["h1", "h2"]).select("rep", "id"), "copies")
    extra = copies.where("id <> rep").select("id")
    return rows.join(extra, "id", "left_anti") if not extra.isEmpty() else rows, copies


def _bucket_topk(dim: int, k: int, least: float):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        ids, x, side = unpack_group(d, np.dtype((np.float32, (dim,))))
        u = unit(x)
        f = u.astype(np.float32)
        split = int((side == 0).sum())
        crossed = split < len(ids)
        out_q, out_c = [], []
        floor = np.float32(least - 2e-6)

        def scan(rows: np.ndarray, cols: np.ndarray) -> None:
            for a in range(0, len(rows), 1024):
                r = rows[a : a + 1024]
                s = f[r] @ f[cols].T
                if not crossed:
                    s[np.arange(len(r)), r] = -2  # a vector isn't its own neighbour
                many = (s >= floor).sum(1)
                big = np.flatnonzero(many > k + 4)
                if len(big):  # keep k and, for ties after rounding, all within a hair of the k-th
                    kth = -np.partition(-s[big], k - 1, axis=1)[:, k - 1]
                    s[big] = np.where(s[big] >= (kth - 2e-6)[:, None], s[big], -2)
                i, j = np.nonzero(s >= floor)
                out_q.append(r[i])
                out_c.append(cols[j])

        at = np.arange(len(ids))
        if crossed:
            scan(at[:split], at[split:])
            scan(at[split:], at[:split])
        else:
            scan(at, at)
        q, c = np.concatenate(out_q), np.concatenate(out_c)
        if not len(q):
            return pd.DataFrame({"q": np.empty(0, np.int64), "near": []})
        cos = np.round(np.einsum("ij,ij->i", u[q], u[c]), 6)
        ok = cos >= least
        q, c, cos = q[ok], c[ok], cos[ok]
        order = np.lexsort((ids[c], -cos, q))
        q, c, cos = q[order], c[order], cos[order]
        cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(cuts, np.diff(np.append(cuts, len(q))))
        q, c, cos = q[place < k], c[place < k], cos[place < k]
        cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        cell = np.empty(len(q), [("id", "<i8"), ("cos", "<f8")])
        cell["id"], cell["cos"] = ids[c], cos
        return pd.DataFrame({"q": ids[q[cuts]], "near": [b.tobytes() for b in np.split(cell, cuts[1:])] if len(cuts) else []})

    return run


def _merge_topk(k: int):
    """Rows (q, near) sorted by q -> the k best of every q over all its rows."""
    kind = np.dtype([("id", "<i8"), ("cos", "<f8")])

    def merged(d: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(b) // kind.itemsize for b in d["near"]])
        cell = np.frombuffer(b"".join(d["near"]), kind)
        q, i, c = np.repeat(d["q"].to_numpy(np.int64), n), cell["id"], cell["cos"]
        order = np.lexsort((i, -c, q))
        q, i, c = q[order], i[order], c[order]
        new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
        q, i, c = q[new], i[new], c[new]
        cuts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(cuts, np.diff(np.append(cuts, len(q)))) + 1
        ok = rank <= k
        return pd.DataFrame({"vec_id": q[ok], "rank": rank[ok].astype(np.int32), "near_id": i[ok], "cosine": c[ok]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for d in batches:
            d = d if held is None else pd.concat([held, d])
            if not len(d):
                continue
            last = d["q"] == d["q"].iloc[-1]  # may go on in the next batch
            if not last.all():
                yield merged(d[~last])
            held = d[last]
        if held is not None and len(held):
            yield merged(held)

    return run


def similar_vectors(vectors: DataFrame, k: int = 10, least: float = 0.8, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", ts_col: str | None = None, tables: int = TABLES) -> DataFrame:
    """(vec_id, rank, near_id, cosine): for every valid current vector its up to
    ``k`` most similar others with cosine >= ``least`` (rounded to 6 decimals, ties
    to the smaller id).

    Every vector is indexed and every vector is a query. Cosines are exact
    (double precision); only retrieval is approximate: pairs within Hamming radius
    tables - 1 of the codes are found for certain, pairs at cosine ``least`` with
    probability codes.MEET at any number of rows, for which there are more tables
    than ``tables`` where the substrings grow. Invalid vectors
    (null, wrong size, null, NaN or infinite elements, all zero) have no rows and
    are no one's neighbours; an empty table gives no rows. Exact copies are
    searched once: of a vector repeated any number of times the k + 1 smallest
    ids can be neighbours, which loses none as ties go to the smaller id.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    packed, copies = distinct_vectors(vectors, dim, id_col, vec_col, ts_col)
    packed = stage(packed, "packed")
    n = packed.count()
    index = MultiIndex.fit(packed, n, dim, tables, least=least)
    near = bucketed(packed, index, dim, n).groupBy("g", "bi", "bj").applyInPandas(_bucket_topk(dim, k, least), "q long, near binary")
    best = near.repartition(slots(spark), "q").sortWithinPartitions("q").mapInPandas(_merge_topk(k), "vec_id long, rank int, near_id long, cosine double")
    if copies.isEmpty():
        return best
    return _with_copies(stage(best, "best"), copies, k)


def _with_copies(best: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Opens the neighbours of representatives out to the copies on either side."""
    from pyspark.sql import Window as W

    # the k + 1 smallest ids of each group: a bounded list, built by a partial top-k
    few = copies.withColumn("_r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = best.join(few.withColumnRenamed("rep", "near_id"), "near_id", "left")
    lists = lists.select("vec_id", F.explode(F.coalesce("ids", F.array("near_id"))).alias("near_id"), "cosine")
    own = few.select(F.col("rep").alias("vec_id"), F.explode("ids").alias("near_id"), F.lit(1.0).alias("cosine"))
    top = lists.unionByName(own).withColumn("_r", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "near_id"))).where(F.col("_r") <= k + 1)
    lists = top.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("near_id").alias("n")))).alias("l"))  # k + 1 entries at most
    x = lists.join(copies.withColumnRenamed("rep", "vec_id"), "vec_id", "left").select(F.coalesce("id", "vec_id").alias("vec_id"), "l")
    x = x.select("vec_id", F.slice(F.filter("l", lambda e: e["n"] != F.col("vec_id")), 1, k).alias("l"))
    return x.select("vec_id", F.posexplode("l").alias("p", "e")).select("vec_id", (F.col("p") + 1).alias("rank"), F.col("e.n").alias("near_id"), (-F.col("e.d")).alias("cosine"))
