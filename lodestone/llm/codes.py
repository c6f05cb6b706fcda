"""Learned binary codes and multi-index hashing over them.

Vectors are rotated by learned orthogonal matrices (iterative quantization on a
bounded sample) and reduced to sign bits. A code is cut into substrings, each
with an index of its own; two codes within Hamming radius m - 1 agree in at least
one of m substrings (pigeonhole), so probing every index at a vector's own
substrings retrieves all of them, and most codes of a larger distance. Retrieved
vectors are then compared as floats. Longer substrings, which larger tables need,
are met less often; as many more of them are used, so that two vectors meet with
the same probability at every number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import in_blocks

#: Rows that the rotations are learned from: those with the smallest id hashes.
SAMPLE_ROWS = 4096
#: Rows that a bucket of an index should hold on average; the substring length follows.
BUCKET_ROWS = 600
#: A larger bucket is cut into blocks of half this size, compared pair by pair in tasks of their own.
BLOCK_ROWS = 16_384
#: Hot buckets up to this number are told to the tasks; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Two vectors at the threshold meet in some substring with at least this probability, at any number of rows.
MEET = 0.97
#: Where that needs more substrings, they are kept shorter and the buckets grow instead.
MOST_TABLES = 512


def valid_vector(v: Column, dim: int) -> Column:
    """Not null, of ``dim`` elements, none of them null, NaN or infinite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def pack_floats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """v array -> x binary: float32 bytes, a sixth of the cost of array cells downstream; null stays null."""
    for d in batches:
        yield d.drop(columns="v").assign(x=[None if v is None else np.asarray(v, np.float32).tobytes() for v in d["v"]])


def unpack(cells: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float32).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that tiny and huge vectors keep their direction
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 11, rounds: int = 20) -> np.ndarray:
    """(dim, bits): columns of as many learned rotations as the bits need.

    Each starts from another random orthogonal matrix and alternates between the
    nearest binary codes and the rotation that fits them best (Procrustes).
    """
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(max(1, -(-bits // dim))):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds if len(sample) >= 2 * dim else 0):
            b = np.where(sample @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(sample.T @ b)
            r = u @ vt
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


def tables_for(width: int, least: float, meet: float = MEET) -> float:
    """Substrings of ``width`` bits by which vectors of cosine ``least`` meet with probability
    ``meet``, for sign bits that are independent: one differs with probability angle / pi."""
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** width
    if same >= meet:
        return 1
    return math.ceil(math.log(1 - meet) / math.log1p(-same)) if same > 1e-12 else math.inf


class MultiIndex:
    """``tables`` substrings of ``width`` bits each."""

    def __init__(self, rotations: np.ndarray, tables: int, width: int):
        self.rotations, self.tables, self.width = rotations, tables, width
        self.weights = 1 << np.arange(width, dtype=np.int64)

    @classmethod
    def fit(cls, packed: DataFrame, rows: int, dim: int, tables: int, least: float = 0.8, meet: float = MEET) -> MultiIndex:
        """packed: (id, x). Learns from SAMPLE_ROWS rows; indexes are for ``rows`` rows. There
        are ``tables`` under learned rotations and as many more under random ones as ``meet``
        at cosine ``least`` needs. Learned bits keep groups together, so they part vectors of
        different groups more often than independent bits; random ones part all alike."""
        width = min(30, max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1e-9))) if rows > BUCKET_ROWS else 4)
        while width and tables_for(width, least, meet) > MOST_TABLES:
            width -= 1  # 0: a single bucket of all rows, compared in full
        every = max(tables, tables_for(width, least, meet)) if width else 1
        learned = min(tables, every)
        got = packed.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS).select("x").collect()  # bounded: SAMPLE_ROWS vectors
        sample = unit(np.frombuffer(b"".join(bytes(r[0]) for r in got), np.float32).reshape(-1, dim)) if got else np.empty((0, dim))
        rotations = [learn_rotations(sample, learned * width), learn_rotations(sample, (every - learned) * width, seed=12, rounds=0)]
        return cls(np.concatenate(rotations, axis=1), every, width)

    def keys(self, u: np.ndarray) -> np.ndarray:
        """(rows, tables) substrings of the rows' codes."""
        out = np.empty((len(u), self.tables), np.int64)
        for t in range(0, self.tables, 32):  # bounds the memory of the bits
            n = min(32, self.tables - t)
            bits = (u @ self.rotations[:, t * self.width : (t + n) * self.width] >= 0).reshape(len(u), n, self.width)
            out[:, t : t + n] = bits @ self.weights
        return out


def hot_buckets(packed: DataFrame, index: MultiIndex, dim: int) -> DataFrame:
    """(g, rows): buckets of more than BLOCK_ROWS rows, about.

    Counted on every few ids by hash, since the numbers only say into how many blocks a
    bucket is cut; all rows are searched either way. Staged, never collected.
    """
    of = max(1, BLOCK_ROWS // 256)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                g = index.keys(unit(unpack(d["x"], dim))) + (np.arange(index.tables, dtype=np.int64) << 32)
                k, n = np.unique(g, return_counts=True)
                yield pd.DataFrame({"g": k, "n": n})

    some = packed.where(F.pmod(F.xxhash64(F.lit("hot"), "id"), F.lit(of)) == 0) if of > 1 else packed
    return stage(some.mapInPandas(run, "g long, n long").groupBy("g").agg((F.sum("n") * of).alias("rows")).where(F.col("rows") > BLOCK_ROWS), "hot")


def bucketed(packed: DataFrame, index: MultiIndex, dim: int, rows: int | None = None) -> DataFrame:
    """Rows (g, bi, bj, side, ids, xs) of packed bucket parts, to be grouped by
    (g, bi, bj). packed: (id, x), or (id, x, p) where p, bytes of one length, travels in
    place of the vector.

    Every vector goes to one bucket per substring. A bucket of more than
    BLOCK_ROWS rows (a hot one may hold a third of all rows) is cut into blocks,
    and every pair of blocks becomes a group of its own, so no task ever holds
    more than two blocks' worth of vectors. side: 0 for block bi, 1 for bj.
    """
    carried = "p" if "p" in packed.columns else "x"
    most = max(1, BLOCK_ROWS // 16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            ids = d["id"].to_numpy(np.int64)
            keys = index.keys(unit(unpack(d["x"], dim)))
            x = np.frombuffer(b"".join(d[carried]), np.uint8).reshape(len(d), -1)
            out: list[tuple] = []
            for t in range(index.tables):
                order = np.argsort(keys[:, t], kind="stable")
                ks = keys[order, t]
                cuts = np.flatnonzero(np.append(True, ks[1:] != ks[:-1]))
                for a, b in zip(cuts, np.append(cuts[1:], len(ks))):
                    g = (t << 32) + int(ks[a])
                    for c in range(a, b, most):  # parts are the smallest pieces that blocks are made of
                        rows = order[c : min(b, c + most)]
                        out.append((g, int(ids[rows[0]]), ids[rows].tobytes(), x[rows].tobytes()))
                if t % 32 == 31:  # bounds the copies of a batch that are held
                    yield pd.DataFrame(out, columns=["g", "part", "ids", "xs"])
                    out = []
            yield pd.DataFrame(out, columns=["g", "part", "ids", "xs"])

    parts = packed.mapInPandas(run, "g long, part long, ids binary, xs binary")
    if rows is not None and rows <= BLOCK_ROWS:
        n = 0
    else:
        hot = hot_buckets(packed, index, dim)
        n = hot.count()
    if not n:
        return parts.select("g", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"), "ids", "xs")
    x = parts.join(F.broadcast(hot) if n <= BROADCAST_BUCKETS else hot, "g", "left")
    x = in_blocks(x, F.coalesce("rows", F.lit(0)), "part", BLOCK_ROWS // 2)
    return x.select("g", F.col("_lo").alias("bi"), F.col("_hi").alias("bj"), (F.col("_i") != F.col("_lo")).cast("int").alias("side"), "ids", "xs")


def unpack_group(d: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, what they carry, side) of a group's rows, in id order."""
    ids = np.frombuffer(b"".join(d["ids"]), np.int64)
    x = np.frombuffer(b"".join(d["xs"]), kind)
    side = np.repeat(d["side"].to_numpy(), [len(b) // 8 for b in d["ids"]])
    order = np.lexsort((ids, side))
    return ids[order], x[order], side[order]


def short_form(dim: int) -> np.dtype:
    """A unit vector in bytes: one a component, the scale, and how far it is off at most; with a label."""
    return np.dtype([("q", "i1", (dim,)), ("scale", "<f4"), ("off", "<f4"), ("label", "<i8")])


def shortened(u: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.empty(len(u), short_form(u.shape[1]))
    out["scale"] = np.abs(u).max(axis=1) / 127
    out["q"] = np.rint(u / out["scale"][:, None].astype(np.float64))
    out["off"] = np.linalg.norm(u - out["q"] * out["scale"][:, None].astype(np.float64), axis=1) * (1 + 1e-6) + 1e-6
    out["label"] = label
    return out
