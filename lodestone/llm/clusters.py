"""Clusters of mutually similar vectors by distributed bisecting k-means.

The node with the largest dispersion is split in two by spherical 2-means, again and
again, until every leaf meets the compactness limit: all its members lie within half
the angle of the threshold around its centre, so any two of them are similar and a
leaf is part of one cluster. Splits are found on bounded samples of nodes in tasks,
all rows are then routed through the trees in one pass, and nodes that are still too
large go through another round with samples of their own; each row carries its node
number, so finished nodes are never read again. Nodes of bounded size are finished
inside tasks. Leaves are joined where they hold similar members: inside a block by
exact comparison, across blocks by searching members of different components with
binary codes and comparing them exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .codes import MultiIndex, bucketed, short_form, shortened, unit, unpack, unpack_group
from .common import components
from .neighbours import distinct_vectors

#: Blocks of at most this many rows are compared in full.
BLOCK_ROWS = 2048
#: Nodes of at most this many rows are finished by one task, which parts them into blocks.
NODE_ROWS = 8 * BLOCK_ROWS
#: Rows of a node that its tree is learned from, and leaves of all trees of a round (64 MB at 64 dimensions).
SAMPLE_ROWS, MOST_LEAVES = 8192, 262_144
#: Two members at the threshold that planes separated meet with at least this probability; a
#: chain may hang on them alone.
MEET = 0.99
CHUNK_ROWS = 1024
TYPICAL = 3


def compactness(least: float) -> float:
    """The cosine to the centre from which any two members of a leaf have cosine ``least``: half its angle."""
    return float(np.sqrt((1 + max(least, -1.0)) / 2)) + 1e-9


def two_means(u: np.ndarray, passes: int = 6) -> np.ndarray | None:
    """Two unit centres, or None where the rows can't be parted."""
    centre = u.sum(0)
    a = u[np.argmin(u @ centre)]
    b = u[np.argmin(u @ a)]
    if float(a @ b) > 1 - 1e-9:
        return None
    c = np.stack([a, b])
    for _ in range(passes):
        s = u @ (c[1] - c[0]) > 0
        if s.all() or not s.any():
            return None
        c = np.stack([u[~s].sum(0), u[s].sum(0)])
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        if (norm < 1e-9).any():
            return None
        c = c / norm
    s = u @ (c[1] - c[0]) > 0
    return None if s.all() or not s.any() else c


@dataclass
class Tree:
    """Planes of a node's splits. split: inner nodes x dim, a row goes to the second child where
    its product is positive; children: node numbers, or ~leaf; centres: of leaves that are
    compact (rows of zeros for others)."""

    split: np.ndarray
    children: np.ndarray
    centres: np.ndarray

    def route(self, u: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(u), np.int64)
        work = [(0, np.arange(len(u)))] if len(self.split) else []
        while work:
            k, rows = work.pop()
            side = (u[rows] @ self.split[k] > 0).astype(np.int64)
            for s in (0, 1):
                own, to = rows[side == s], int(self.children[k, s])
                if to < 0:
                    at[own] = ~to
                elif len(own):
                    work.append((to, own))
        return at

    def to_bytes(self) -> dict[str, bytes]:
        return {"split": self.split.astype("<f4").tobytes(), "children": self.children.astype("<i4").tobytes(), "centres": self.centres.astype("<f4").tobytes()}

    @classmethod
    def of(cls, row, dim: int) -> Tree:
        f = lambda c, t, w: np.frombuffer(bytes(row[c]), t).reshape(-1, w)
        return cls(f("split", "<f4", dim), f("children", "<i4", 2), f("centres", "<f4", dim))


def grow(u: np.ndarray, most: int, enough: int, compact: float) -> Tree:
    """The tree of a sample: the leaf of largest dispersion is split until there are ``most``
    leaves, or all have at most ``enough`` rows, are compact, or can't be parted."""
    split, children, leaves = [], [], []
    heap: list = []
    serial = 0

    def push(rows: np.ndarray, parent: int, side: int) -> None:
        nonlocal serial
        total = u[rows].sum(0)
        heapq.heappush(heap, (float(np.linalg.norm(total)) - len(rows), serial, rows, parent, side))
        serial += 1

    def close(rows: np.ndarray, parent: int, side: int, compact_at: np.ndarray | None) -> None:
        if parent >= 0:
            children[parent][side] = ~len(leaves)
        leaves.append(np.zeros(u.shape[1]) if compact_at is None else compact_at)

    push(np.arange(len(u)), -1, 0)
    while heap:
        _, _, rows, parent, side = heapq.heappop(heap)
        centre = u[rows].sum(0)
        centre /= max(float(np.linalg.norm(centre)), 1e-12)
        if len(rows) <= enough:
            close(rows, parent, side, None)
        elif (u[rows] @ centre).min() >= compact:
            close(rows, parent, side, centre)
        elif len(leaves) + len(heap) + 2 > most or (c := two_means(u[rows])) is None:
            close(rows, parent, side, None)
        else:
            if parent >= 0:
                children[parent][side] = len(split)
            plane = c[1] - c[0]
            over = u[rows] @ plane.astype(np.float32).astype(np.float64) > 0
            split.append(plane)
            children.append([0, 0])
            for s in (0, 1):
                push(rows[over == bool(s)], len(split) - 1, s)
    return Tree(np.array(split).reshape(-1, u.shape[1]), np.array(children).reshape(-1, 2), np.array(leaves))


def _learner(dim: int, most: int, compact: float):
    def learn(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id")
        enough = max(1, int(len(d) * 0.5 * BLOCK_ROWS / int(d["n"].iloc[0])))
        return pd.DataFrame([{"node": int(d["node"].iloc[0]), **grow(unit(unpack(d["x"], dim)), most, enough, compact).to_bytes()}])

    return learn


def parted(packed: DataFrame, rows: int, dim: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """(rows, cliques): rows(id, x, node) of nodes that one task can finish, and
    cliques(id, x, node, cosine) of compact leaves that are larger, which need no comparison.

    Each round learns a tree a node from a sample in a task of its own and routes the rows
    of large nodes once. What the driver holds is one count a large node and the trees'
    planes, at most MOST_LEAVES.
    """
    compact = compactness(least)
    done: list[DataFrame] = []
    cliques: list[DataFrame] = []
    now, sizes, first = packed.withColumn("node", F.lit(0).cast("long")), {0: rows}, 1
    while sizes:
        most = max(2, min(SAMPLE_ROWS // 32, MOST_LEAVES // len(sizes)))
        spark = packed.sparkSession
        counts = F.broadcast(spark.createDataFrame(list(sizes.items()), "node long, n long"))  # at most MOST_LEAVES rows
        if sizes.keys() == {0}:
            large = now.withColumn("n", F.lit(rows))
        else:
            large = now.join(counts, "node")
            done.append(now.join(counts.select("node"), "node", "left_anti").select("id", "x", "node"))
        some = large.where(F.pmod(F.xxhash64("id", "node"), F.lit(1 << 30)) < F.lit(float(SAMPLE_ROWS)) / F.col("n") * float(1 << 30))

        got = some.groupBy("node").applyInPandas(_learner(dim, most, compact), "node long, split binary, children binary, centres binary").collect()  # MOST_LEAVES planes and centres
        trees, starts = {}, {}
        for r in sorted(got, key=lambda r: r["node"]):
            t = Tree.of(r, dim)
            parts = max(len(t.centres), -(-2 * sizes[r["node"]] // NODE_ROWS) if len(t.centres) == 1 and not t.centres.any() else 1)
            trees[r["node"]], starts[r["node"]] = (t, parts), first
            first += parts

        def route(batches: Iterator[pd.DataFrame], trees: dict = trees, starts: dict = starts) -> Iterator[pd.DataFrame]:
            for d in batches:
                if not len(d):
                    continue
                ids, node = d["id"].to_numpy(np.int64), d["node"].to_numpy(np.int64)
                u = unit(unpack(d["x"], dim))
                new, cosine = node.copy(), np.full(len(d), np.nan)
                for k in np.unique(node):
                    if k not in trees:
                        continue
                    own = np.flatnonzero(node == k)
                    t, parts = trees[k]
                    leaf = t.route(u[own])
                    if parts > len(t.centres):  # all directions equal: members meet for certain in every index
                        with np.errstate(over="ignore"):
                            leaf = ((ids[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                    else:
                        near = np.einsum("ij,ij->i", u[own], t.centres[leaf].astype(np.float64))
                        norm = np.linalg.norm(t.centres[leaf].astype(np.float64), axis=1)
                        near = near / np.where(norm > 0, norm, 1)
                        cosine[own] = np.where((norm > 0) & (near >= compact), near, np.nan)
                    new[own] = starts[k] + leaf
                yield pd.DataFrame({"id": ids, "x": d["x"].to_numpy(), "node": new, "cosine": cosine})

        routed = stage(large.select("id", "x", "node").mapInPandas(route, "id long, x binary, node long, cosine double"), "routed")
        if any(t.centres.any() for t, _ in trees.values()):
            cliques.append(routed.where("cosine is not null"))
        now = routed.where("cosine is null").drop("cosine")
        sizes = {r["node"]: r["n"] for r in now.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > NODE_ROWS).collect()}
        if len(sizes) > MOST_LEAVES // 2:
            break  # tasks part the rest, which takes more memory of each
    done.append(now)
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return union(done), union(cliques) if cliques else None


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows over the (symmetric) links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def close_pairs(u: np.ndarray, v: np.ndarray, least: float, apart: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of u and of v whose cosine, rounded to 6 decimals, is >= least; with ``apart``,
    labels of the rows of either, only those of different labels."""
    f, g = u.astype(np.float32), v.astype(np.float32)
    out_i, out_j = [], []
    for a in range(0, len(u), CHUNK_ROWS):
        s = f[a : a + CHUNK_ROWS] @ g.T
        near = s >= least - 3e-6
        if apart is not None:
            near &= apart[0][a : a + CHUNK_ROWS, None] != apart[1]
        i, j = np.nonzero(near)
        edge = s[i, j] < least + 3e-6
        ok = np.ones(len(i), bool)
        ok[edge] = np.round(np.einsum("ij,ij->i", u[a + i[edge]], v[j[edge]]), 6) >= least
        out_i.append(a + i[ok])
        out_j.append(j[ok])
    return np.concatenate(out_i) if out_i else np.empty(0, np.int64), np.concatenate(out_j) if out_j else np.empty(0, np.int64)


def _finish_node(dim: int, least: float, compact: float):
    """Parts a node that is larger than a block further, then finishes its blocks one by one."""
    finish = _finish_block(dim, least, compact)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("id", ignore_index=True)
        u = unit(unpack(d["x"], dim))
        work, done = [np.arange(len(d))], []
        while work:
            rows = work.pop()
            if len(rows) <= BLOCK_ROWS:
                done.append(rows)
                continue
            c = two_means(u[rows])  # None where all directions are equal, whose parts meet again in every index
            s = u[rows] @ (c[1] - c[0]) > 0 if c is not None else np.arange(len(rows)) % 2 == 1
            work += [rows[s], rows[~s]]
        return pd.concat([finish(d.iloc[np.sort(rows)]) for rows in done])

    return run


def _finish_block(dim: int, least: float, compact: float):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        ids, u = d["id"].to_numpy(np.int64), unit(unpack(d["x"], dim))
        i, j = close_pairs(u, u, least)
        keep = i != j
        i, j = i[keep], j[keep]
        leaf, cos, size = np.arange(len(ids)), np.ones(len(ids)), np.ones(len(ids), np.int64)
        place = np.zeros(len(ids), np.int32)
        pairs = i, j
        serial = 0
        heap: list = [(-np.inf, serial, np.arange(len(ids)), i, j)]
        while heap:
            _, _, rows, a, b = heapq.heappop(heap)
            if not len(a):
                continue  # no two are similar: compact leaves of one row each
            linked = np.unique(a)
            rows = linked  # rows without a similar row are leaves of their own
            c = u[rows].sum(0)
            c /= max(np.linalg.norm(c), 1e-12)
            near = u[rows] @ c
            parts = None if near.min() >= compact else two_means(u[rows])
            if parts is None and (near.min() >= compact or len(rows) == 1 or len(rows) == 2):
                leaf[rows], cos[rows], size[rows] = rows[0], near, len(rows)
                place[rows[np.lexsort((ids[rows], -near))]] = np.arange(len(rows))
                continue
            side = np.zeros(len(u), bool)
            side[rows] = u[rows] @ (parts[1] - parts[0]) > 0 if parts is not None else np.arange(len(rows)) % 2 == 1
            for s in (False, True):
                own = rows[side[rows] == s]
                e = (side[a] == s) & (side[b] == s)
                serial += 1
                spread = len(own) - float(np.linalg.norm(u[own].sum(0)))
                heapq.heappush(heap, (-spread, serial, own, a[e], b[e]))
        # a leaf is part of one cluster; leaves with a similar pair between them are joined
        i, j = pairs
        other = leaf[i] != leaf[j]
        near = leaf != np.arange(len(ids))
        a, b = np.append(leaf[i[other]], np.flatnonzero(near)), np.append(leaf[j[other]], leaf[near])
        comp = _joined(len(ids), np.append(a, b), np.append(b, a))
        return pd.DataFrame({
            "id": ids, "node": d["node"].to_numpy(), "leaf": ids[leaf], "comp": ids[comp], "size": size[leaf], "cosine": cos, "place": place, "x": d["x"].to_numpy(),
        })

    return run


def _shortened(dim: int):
    """(id, comp, x) -> (id, x, p): a quarter of the bytes travels to the tables, with the component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                p = shortened(unit(unpack(d["x"], dim)), d["comp"].to_numpy(np.int64))
                yield pd.DataFrame({"id": d["id"], "x": d["x"], "p": [r.tobytes() for r in p]})

    return run


def _links(dim: int, least: float):
    """(a, b, i, j): pairs of components with similar members in a bucket, each once; where the
    shortened vectors leave it open, every pair of members i, j that may be similar."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        ids, p, side = unpack_group(d, short_form(dim))
        names, of = np.unique(p["label"], return_inverse=True)
        sure, open_i, open_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        split = int((side == 0).sum())
        a, b = (np.arange(split), np.arange(split, len(ids))) if split < len(ids) else (np.arange(len(ids)),) * 2
        f = (p["q"] * p["scale"][:, None]).astype(np.float32)
        off = p["off"]
        for s in range(0, len(a) if len(names) > 1 else 0, CHUNK_ROWS):
            r = a[s : s + CHUNK_ROWS]
            c = f[r] @ f[b].T
            # the true cosine differs by at most both errors, each against a vector of about unit length
            i, j = np.nonzero((c >= least - 1e-5 - (off[r].max() + off[b].max()) * 1.02) & (of[r][:, None] != of[b]))
            c, i, j = c[i, j], r[i], b[j]
            slack = (off[i] + off[j]) * 1.02 + 1e-5
            keep = (i < j) | (split < len(ids))
            c, i, j, slack = c[keep], i[keep], j[keep], slack[keep]
            key = np.minimum(of[i], of[j]) * len(names) + np.maximum(of[i], of[j])
            known = c - slack >= least
            sure.append(np.unique(key[known]))
            maybe = ~known & (c + slack >= least) & ~np.isin(key, sure[-1])
            open_i.append(i[maybe])
            open_j.append(j[maybe])
        pairs = np.unique(np.concatenate(sure))
        i, j = np.concatenate(open_i), np.concatenate(open_j)
        ends = lambda k: names[k]
        return pd.DataFrame({
            "a": np.append(ends(pairs // len(names)), ends(of[i])), "b": np.append(ends(pairs % len(names)), ends(of[j])),
            "i": pd.array([None] * len(pairs) + ids[i].tolist(), "Int64"), "j": pd.array([None] * len(pairs) + ids[j].tolist(), "Int64"),
        })

    return run


def _settled(hits: DataFrame, rows: DataFrame, dim: int, least: float) -> DataFrame:
    """(a, b): the sure links and those whose open pairs of members are similar indeed, by whole vectors."""
    sure = hits.where("i is null").select("a", "b")
    still = hits.where("i is not null").select("a", "b", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().join(sure.distinct(), ["a", "b"], "left_anti")
    x = still.join(rows.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i").join(rows.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                c = np.round(np.einsum("ij,ij->i", unit(unpack(d["xi"], dim)), unit(unpack(d["xj"], dim))), 6)
                yield d.loc[c >= least, ["a", "b"]]

    return sure.unionByName(x.mapInPandas(run, "a long, b long"))


class Clustering:
    """The result of :func:`cluster`."""

    def __init__(self, rows: DataFrame, roots: DataFrame, copies: DataFrame, dim: int):
        self._rows, self._roots, self._copies, self._dim = rows, roots, copies, dim

    def _assigned(self, *more: str) -> DataFrame:
        x = self._rows.join(self._roots.toDF("comp", "root"), "comp", "left").select("id", "leaf", "size", "cosine", "place", F.coalesce("root", "comp").alias("cluster"), *more)
        c = self._copies.toDF("leader", "other").where("leader <> other")
        other = x.join(c, x["id"] == c["leader"]).select(F.col("other").alias("id"), "leaf", "size", "cosine", F.lit(None).cast("int").alias("place"), "cluster", *more)
        return x.unionByName(other)

    def members(self) -> DataFrame:
        """(vec_id, cluster, leaf, size) of clusters with two members and more;
        cluster is its smallest vec_id, size the cluster's."""
        x = self._assigned()
        sizes = x.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
        return x.join(sizes, "cluster").select(F.col("id").alias("vec_id"), "cluster", "leaf", F.col("n").alias("size"))

    def leaves(self) -> DataFrame:
        """(leaf, cluster, size, least_cosine, typical_1..3) of leaves with two
        members and more; typical members are the nearest to the leaf's centre."""
        x = self._assigned()
        first = [F.min(F.when(F.col("place") == i, F.col("id"))).alias(f"typical_{i + 1}") for i in range(TYPICAL)]
        return x.groupBy("leaf", "cluster").agg(F.count("*").alias("n"), F.round(F.min("cosine"), 6).alias("least_cosine"), *first).where("n > 1").withColumnRenamed("n", "size")

    def clusters(self) -> DataFrame:
        """(cluster, size, leaves, typical_1..3, cosine_1) of clusters with two members and more: typical
        members are the nearest to the cluster's centre, the mean of its unit vectors (cosines rounded
        to 6 decimals, ties to the smaller id).

        Sums are taken per batch before they are shuffled, and only the best members of a
        task are, so a cluster may hold any share of the rows.
        """
        dim = self._dim
        x = stage(self._assigned("x"), "assigned")
        sizes = x.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("leaf").alias("leaves")).where("size > 1")
        x = x.join(sizes.select("cluster"), "cluster", "left_semi")

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                if len(d):
                    yield _summed(d["cluster"].to_numpy(np.int64), unit(unpack(d["x"], dim)))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for d in batches:  # sorted by cluster, which may go on in the next batch
                d = d if held is None else pd.concat([held, d])
                s = _summed(d["cluster"].to_numpy(np.int64), np.frombuffer(b"".join(d["s"]), np.float64).reshape(-1, dim))
                yield s.iloc[:-1]
                held = s.iloc[-1:]
            if held is not None:
                yield held

        kind = "cluster long, s binary"
        centres = x.select("cluster", "x").mapInPandas(part, kind).repartition("cluster").sortWithinPartitions("cluster").mapInPandas(whole, kind)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                if len(d):
                    s = np.frombuffer(b"".join(d["s"]), np.float64).reshape(-1, dim)
                    c = np.einsum("ij,ij->i", unit(unpack(d["x"], dim)), s) / np.maximum(np.linalg.norm(s, axis=1), 1e-300)
                    yield pd.DataFrame({"cluster": d["cluster"], "id": d["id"], "cosine": np.round(c, 6)})

        y = x.select("cluster", "id", "x").join(centres, "cluster").mapInPandas(near, "cluster long, id long, cosine double")
        y = y.withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("cosine"), "id"))).where(F.col("place") <= TYPICAL)
        first = [F.min(F.when(F.col("place") == i + 1, F.col("id"))).alias(f"typical_{i + 1}") for i in range(TYPICAL)]
        return sizes.join(y.groupBy("cluster").agg(*first, F.max("cosine").alias("cosine_1")), "cluster")


def _summed(cluster: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """(cluster, s): one sum a cluster, in the order of clusters."""
    order = np.argsort(cluster, kind="stable")
    cluster = cluster[order]
    cuts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
    return pd.DataFrame({"cluster": cluster[cuts], "s": [v.tobytes() for v in np.add.reduceat(x[order], cuts, axis=0)]})


def _clique_rows(cliques: DataFrame) -> DataFrame:
    """Members of compact leaves that no task gathered, under their smallest ids."""
    own = cliques.groupBy("node").agg(F.min("id").alias("leaf"), F.count("*").alias("size"))
    top = cliques.select("id", "node", "cosine").withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.desc("cosine"), "id")) - 1).where(F.col("place") < TYPICAL)
    x = cliques.join(F.broadcast(own), "node").join(F.broadcast(top.select("id", "place")), "id", "left")  # a row and TYPICAL rows a leaf, at most MOST_LEAVES
    return x.select("id", "node", "leaf", F.col("leaf").alias("comp"), "size", "cosine", "place", "x")


def cluster(vectors: DataFrame, least: float = 0.8, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", ts_col: str | None = None) -> Clustering:
    """Clusters of valid current vectors: chains of cosines >= ``least``.

    Invalid vectors (see codes.valid_vector) are left out; exact copies are
    clustered once and join the cluster of their smallest id; an empty table gives
    empty results. Leaves are compact (see compactness), so members of a leaf are
    never compared across blocks. A cluster that planes cut is rejoined inside blocks
    by exact comparison and across them over the codes of all its members, the one
    inexact step: a link is found with probability MEET or more, whatever the leaves'
    radius and the number of rows.
    """
    packed, copies = distinct_vectors(vectors, dim, id_col, vec_col, ts_col)
    packed = stage(packed, "packed") if not copies.isEmpty() else packed
    n = packed.count()
    if n > NODE_ROWS:
        nodes, cliques = parted(packed, n, dim, least)
    else:
        nodes, cliques = packed.withColumn("node", F.lit(0).cast("long")), None

    kind = "id long, node long, leaf long, comp long, size long, cosine double, place int, x binary"
    rows = nodes.groupBy("node").applyInPandas(_finish_node(dim, least, compactness(least)), kind)
    rows = stage(rows if cliques is None else rows.unionByName(_clique_rows(cliques)), "leaves")
    roots = rows.sparkSession.createDataFrame([], "node long, root long")
    if n > BLOCK_ROWS:
        index = MultiIndex.fit(rows, n, dim, 0, least=least, meet=MEET)  # links between groups: random bits only
        members = rows.select("id", "comp", "x").mapInPandas(_shortened(dim), "id long, x binary, p binary")
        met = stage(bucketed(members, index, dim, n).groupBy("g", "bi", "bj").applyInPandas(_links(dim, least), "a long, b long, i long, j long"), "met")
        hits = stage(_settled(met, rows, dim, least).distinct(), "links")
        if not hits.isEmpty():
            roots = stage(components(hits), "roots")
    return Clustering(rows, roots, copies, dim)


def consecutive(members: DataFrame, width: int = 100_000) -> DataFrame:
    """(vec_a, vec_b): every member with the next larger one of its cluster.

    A cluster may hold a third of all rows, so members are chained inside id
    ranges of ``width`` ids, and the ranges of a cluster over a small table of the
    ranges' ends.
    """
    x = members.select("cluster", "vec_id", F.floor(F.col("vec_id") / width).alias("range"))
    inner = x.withColumn("next", F.lead("vec_id").over(W.partitionBy("cluster", "range").orderBy("vec_id"))).where("next is not null").select(F.col("vec_id").alias("vec_a"), F.col("next").alias("vec_b"))
    ends = x.groupBy("cluster", "range").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    outer = ends.withColumn("next", F.lead("lo").over(W.partitionBy("cluster").orderBy("range"))).where("next is not null").select(F.col("hi").alias("vec_a"), F.col("next").alias("vec_b"))
    return inner.unionByName(outer)
