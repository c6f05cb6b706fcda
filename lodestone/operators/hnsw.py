"""Approximate search on hierarchical proximity graphs, one graph per shard.

Vectors are dealt to shards of bounded size by their nearest centre, a shard's
graph is built inside one task and kept as one row of packed arrays, and a query
visits the shards of its nearest centres only. Vectors are inserted in vec_id
order and levels follow from a shard's positions, so results are reproducible.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import check_array, exact_keys, to_matrix
from ..types import HnswParams, Metric, check_dim, check_k
from . import storage
from .blocks import QUERY_BLOCK, collected, masked, packed
from .topk import RESULT, best, pad, screen, trim_rows

#: One row a shard: vectors, levels and links as packed arrays (see Graph.to_bytes).
GRAPH = "shard int, centre int, n long, ids binary, x binary, level binary, links binary"
RAW = "query_id long, kind string, shard int, step int, layer int, vec_id long, key double"
SHARD_ROWS = 20_000
#: Present nodes up to which candidates of new ones come from a scan, which in batches is faster than walking.
SCAN_ROWS = 65_536
#: Passing vectors that a scan takes, at least, in the time of one that a filtered walk passes (measured: 100 and more).
SCAN_GAIN = 16
#: Centres are learned from at most this many rows, and there are at most MOST_CENTRES (32 MB at 64
#: dimensions in double precision); with more shards than that a centre has several.
CENTRE_SAMPLE, MOST_CENTRES = 262_144, 65_536
BROADCAST_BYTES = 64 << 20
BATCH = 256
MOST_TASKS = 20_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def splitmix(seed: int, start: int, n: int) -> np.ndarray:
    """Outputs start .. start + n - 1 of the generator; each is a function of its number alone."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + (np.arange(start + 1, start + n + 1, dtype=np.uint64)) * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def levels(seed: int, start: int, n: int, m: int) -> np.ndarray:
    """Exponentially distributed levels: floor(-ln u / ln m), u uniform in (0, 1)."""
    u = np.maximum((splitmix(seed, start, n) >> np.uint64(11)).astype(np.float64) / float(1 << 53), np.finfo(np.float64).tiny)
    return np.floor(-np.log(u) * (1 / math.log(m))).astype(np.int64)


def even_positions(n: int, cap: int) -> list[int]:
    """All of n positions, or ``cap`` of them spread evenly from first to last."""
    if n <= cap:
        return list(range(n))
    return [i * (n - 1) // max(cap - 1, 1) for i in range(cap)]


def even_sample(items: Column, cap: int) -> Column:
    """The column form of even_positions over an array."""
    n = F.size(items)
    if cap <= 0:
        return F.slice(items, 1, 0)
    picked = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.element_at(items, (F.floor(i * (n - 1) / F.lit(max(cap - 1, 1))) + 1).cast("int")))
    return F.when(n <= cap, items).otherwise(picked)


class Graph:
    """One shard's graph over positions 0 .. n-1; links are padded with -1."""

    def __init__(self, dim: int, metric: Metric, params: HnswParams):
        self.dim, self.metric, self.params = dim, metric, params
        self.x = np.empty((0, dim), np.float32)
        self.level = np.empty(0, np.int64)
        self.links: list[np.ndarray] = [np.empty((0, params.m_max0), np.int32)]

    @property
    def n(self) -> int:
        return len(self.x)

    @property
    def top(self) -> int:
        return int(self.level.max()) if self.n else -1

    @property
    def entry(self) -> int:
        """The first node of the highest level."""
        return int(self.level.argmax()) if self.n else -1

    def cap(self, layer: int) -> int:
        return self.params.m if layer else self.params.m_max0

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        near = self.links[layer][node]
        return near[near >= 0]

    # -- keys
    def keys(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of one query or row by row."""
        y = self.x[nodes]
        if self.metric is Metric.INNER_PRODUCT:
            return -np.einsum("ij,ij->i", y, np.broadcast_to(q, y.shape))
        d = y - q
        return np.einsum("ij,ij->i", d, d)

    def table(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys of the rows of a against those of b, also in stacks."""
        dots = a @ np.swapaxes(b, -1, -2)
        if self.metric is Metric.INNER_PRODUCT:
            return -dots
        dots *= -2
        dots += (a * a).sum(-1)[..., :, None]
        dots += (b * b).sum(-1)[..., None, :]
        return dots

    # -- walking
    def walk(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int, keep: np.ndarray | None = None, width: int = 4, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, keys), queries x ef: the ef best reached nodes of every query, padded with -1 and inf.

        All queries walk in step: each expands its ``width`` best open nodes, unless the
        best is worse than the ef-th found. ``entry``: queries x starts, padded
        with -1. Nodes that ``keep`` rejects are walked through but not returned, and
        while fewer than ef are held the walk goes on. A query that has evaluated more
        than ``limit`` nodes is given up and returned without any.
        """
        rows = len(q)
        seen = np.zeros(rows, np.int64)
        mark = np.full(rows * self.n, -1, np.int32)
        found, best_key = np.full((rows, ef), -1, np.int64), np.full((rows, ef), np.inf, np.float32)
        todo, todo_key = np.full((rows, 0), -1, np.int64), np.full((rows, 0), np.inf, np.float32)
        r, c = np.nonzero(entry >= 0)
        new = entry[r, c].astype(np.int64)
        links = self.links[layer]
        live = np.arange(rows)
        while len(r):
            # r: ascending rows, new: nodes not seen before (repeats within the step are dropped)
            flat = r * self.n + new
            mark[flat] = np.arange(len(flat), dtype=np.int32)
            first = mark[flat] == np.arange(len(flat))
            r, new = r[first], new[first]
            seen += np.bincount(r, minlength=rows)
            k = self.keys(q[r], new).astype(np.float32)
            ok = k < best_key[r].max(1) if len(r) < rows else k < best_key.max(1)[r]
            r, new, k = r[ok], new[ok], k[ok]
            fresh, fresh_key = _pad(r, new, k, rows, live)
            if keep is None:
                found[live], best_key[live] = _least(np.concatenate([found[live], fresh], 1), np.concatenate([best_key[live], fresh_key], 1), ef)
            else:
                kept_key = np.where((fresh >= 0) & keep[fresh], fresh_key, np.inf)
                found[live], best_key[live] = _least(np.concatenate([found[live], np.where(np.isfinite(kept_key), fresh, -1)], 1), np.concatenate([best_key[live], kept_key], 1), ef)
            worst = best_key[live].max(1)
            pool, pool_key = np.concatenate([todo, fresh], 1), np.concatenate([todo_key, fresh_key], 1)
            pool_key[pool_key > worst[:, None]] = np.inf
            order = np.argsort(pool_key, axis=1, kind="stable")
            most = int(np.isfinite(pool_key).sum(1).max(initial=0))
            order = order[:, :most]
            pool, pool_key = np.take_along_axis(pool, order, 1), np.take_along_axis(pool_key, order, 1)
            on = np.isfinite(pool_key[:, 0]) if most else np.zeros(len(live), bool)
            if limit is not None:
                on &= seen[live] <= limit
            live, pool, pool_key = live[on], pool[on], pool_key[on]
            if not len(live):
                break
            i, j = np.nonzero(np.isfinite(pool_key[:, :width]))
            near = links[pool[i, j]]
            todo, todo_key = pool[:, width:], pool_key[:, width:]
            r, new = np.repeat(live[i], near.shape[1]), near.ravel().astype(np.int64)
            ok = new >= 0
            r, new = r[ok], new[ok]
            ok = mark[r * self.n + new] < 0
            r, new = r[ok], new[ok]
            if not len(r) and todo.shape[1] and np.isfinite(todo_key[:, 0]).any():
                # nothing new from these: go on with the open nodes that are left
                while not len(r):
                    on = np.isfinite(todo_key[:, 0]) if todo.shape[1] else np.zeros(len(live), bool)
                    live, todo, todo_key = live[on], todo[on], todo_key[on]
                    if not len(live):
                        break
                    i, j = np.nonzero(np.isfinite(todo_key[:, :width]))
                    near = links[todo[i, j]]
                    todo, todo_key = todo[:, width:], todo_key[:, width:]
                    r, new = np.repeat(live[i], near.shape[1]), near.ravel().astype(np.int64)
                    ok = new >= 0
                    r, new = r[ok], new[ok]
                    ok = mark[r * self.n + new] < 0
                    r, new = r[ok], new[ok]
        if limit is not None:
            found[seen > limit], best_key[seen > limit] = -1, np.inf
        order = np.lexsort((found, best_key), axis=1)
        return np.take_along_axis(found, order, 1), np.take_along_axis(best_key, order, 1)

    def descend(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        """Of every query the node where no neighbour on the layer is strictly better."""
        at, key = at.copy(), self.keys(q, at)
        live = np.arange(len(q))
        while len(live):
            near = self.links[layer][at[live]]
            k = self.keys(np.repeat(q[live], near.shape[1], axis=0), near.ravel()).reshape(near.shape)
            k[near < 0] = np.inf
            i = k.argmin(1)
            better = k[np.arange(len(live)), i] < key[live]
            live, i, k, near = live[better], i[better], k[better], near[better]
            at[live], key[live] = near[np.arange(len(live)), i], k[np.arange(len(live)), i]
        return at

    # -- building
    def choose(self, near: np.ndarray, key: np.ndarray, cap: int) -> np.ndarray:
        """rows x cap: spread-out neighbours of every row, padded with -1. Candidates ascend by
        key; one is kept if it is no nearer to a kept one than to the row itself."""
        out = np.full((len(near), cap), -1, np.int32)
        step = max(1, (24 << 20) // (4 * max(near.shape[1], 1) * max(self.dim, near.shape[1])))
        for a in range(0, len(near), step):
            ids, k = near[a : a + step], key[a : a + step]
            v = self.x[ids]
            between = self.table(v, v)
            out_of = ~np.isfinite(k)
            count = np.zeros(len(ids), np.int64)
            for c in range(ids.shape[1]):
                take = np.flatnonzero(~out_of[:, c] & (count < cap))
                if not len(take):
                    if (count >= cap).all() or out_of[:, c:].all():
                        break
                    continue
                out[a + take, count[take]] = ids[take, c]
                count[take] += 1
                out_of[take, c + 1 :] |= between[take, c, c + 1 :] < k[take, c + 1 :]
        return out

    def extend(self, x: np.ndarray, level: np.ndarray) -> None:
        """Inserts rows in order, in batches whose members also see each other."""
        at = 0
        while at < len(x):
            size = min(BATCH, max(16, self.n), len(x) - at)
            self._insert(x[at : at + size].astype(np.float32), level[at : at + size])
            at += size

    def _insert(self, q: np.ndarray, level: np.ndarray) -> None:
        old, old_top, entry = self.n, self.top, self.entry
        new = np.arange(old, old + len(q))
        self.x = np.concatenate([self.x, q])
        self.level = np.concatenate([self.level, level])
        for layer in range(max(old_top, int(level.max())) + 1):
            if layer == len(self.links):
                self.links.append(np.full((old, self.cap(layer)), -1, np.int32))
            self.links[layer] = np.concatenate([self.links[layer], np.full((len(q), self.cap(layer)), -1, np.int32)])
        mates = self.table(q, q)
        mates[np.triu_indices(len(q))] = np.inf  # of the batch, those before
        ef = self.params.ef_construction
        starts = np.full((len(q), 1), entry, np.int64)
        for layer in range(max(old_top, int(level.max())), -1, -1):
            own = np.flatnonzero(level >= layer)
            if layer <= old_top:
                far = np.flatnonzero(level < layer)
                if len(far):
                    starts[far, 0] = self.descend(q[far], starts[far, 0], layer)
            if not len(own):
                continue
            if layer > old_top:
                near, key = np.empty((len(own), 0), np.int64), np.empty((len(own), 0), np.float32)
            else:
                near, key = self._candidates(q[own], starts[own], ef, layer, old)
                if starts.shape[1] < near.shape[1]:
                    starts = np.concatenate([starts, np.full((len(q), near.shape[1] - starts.shape[1]), -1)], 1)
                starts[own] = -1
                starts[own, : near.shape[1]] = near
            with_mates = np.where(level[None, :] >= layer, mates[own], np.inf)
            near = np.concatenate([near, np.broadcast_to(new, with_mates.shape)], 1)
            key = np.concatenate([key, with_mates], 1)
            near, key = _least(near, key, min(ef, near.shape[1]), ordered=True)
            self._connect(new[own], self.choose(near, key, self.cap(layer)), layer)

    def _candidates(self, q: np.ndarray, starts: np.ndarray, ef: int, layer: int, present: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best present nodes on a layer."""
        if present > SCAN_ROWS:
            return self.walk(q, starts, ef, layer)
        on = np.flatnonzero(self.level[:present] >= layer)
        key = self.table(q, self.x[on])
        if len(on) > ef:
            at = np.argpartition(key, ef - 1, axis=1)[:, :ef]
            return on[at], np.take_along_axis(key, at, 1)
        return np.broadcast_to(on, key.shape), key

    def _connect(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """Links both ways; a node with more links than the cap chooses among them anew."""
        links, cap = self.links[layer], self.cap(layer)
        links[nodes] = chosen
        i, j = np.nonzero(chosen >= 0)
        back, of = chosen[i, j].astype(np.int64), nodes[i]
        order = np.argsort(back, kind="stable")
        back, of = back[order], of[order]
        hosts, first, n = np.unique(back, return_index=True, return_counts=True)
        if not len(hosts):
            return
        wide = np.full((len(hosts), int(n.max())), -1, np.int64)
        wide[np.repeat(np.arange(len(hosts)), n), np.arange(len(back)) - np.repeat(first, n)] = of
        every = np.concatenate([links[hosts], wide], 1)
        count = (every >= 0).sum(1)
        order = np.argsort(every < 0, axis=1, kind="stable")
        every = np.take_along_axis(every, order, 1)
        fits = count <= cap
        links[hosts[fits]] = every[fits][:, :cap]
        if not fits.all():
            h, e = hosts[~fits], every[~fits][:, : int(count.max())]
            key = self.keys(np.repeat(self.x[h], e.shape[1], axis=0), e.ravel()).reshape(e.shape)
            key[e < 0] = np.inf
            e, key = _least(e, key, e.shape[1], ordered=True)
            links[h] = self.choose(e, key, cap)

    # -- searching
    def search(self, q: np.ndarray, k: int, ef: int, keep: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, keys), queries x k, padded with -1 and inf.

        To hold ef nodes that ``keep`` lets through, a walk passes about ef / (their share)
        nodes. Where scanning the kept ones takes no longer (SCAN_GAIN), and for queries whose
        walk evaluates more than these or doesn't reach k, they are scanned (ties by ``names``).
        """
        k = min(k, self.n)
        if not k:
            return np.empty((len(q), 0), np.int64), np.empty((len(q), 0), np.float32)
        ef = min(max(ef, k), self.n)
        kept = limit = None
        if keep is not None:
            kept = np.flatnonzero(keep)
            if names is not None:
                kept = kept[np.argsort(names[kept], kind="stable")]
            if len(kept) ** 2 <= SCAN_GAIN * ef * self.n:
                return self.scan(q, k, kept)
            limit = len(kept)
        out = []
        step = max(1, min(BATCH, (64 << 20) // self.n))
        for a in range(0, len(q), step):
            y = q[a : a + step]
            at = np.full(len(y), self.entry, np.int64)
            for layer in range(self.top, 0, -1):
                at = self.descend(y, at, layer)
            out.append([v[:, :k] for v in self.walk(y, at[:, None], ef, 0, keep, limit=limit)])
        nodes, key = np.concatenate([n for n, _ in out]), np.concatenate([v for _, v in out])
        if kept is not None:
            short = np.flatnonzero(nodes[:, -1] < 0)
            nodes[short], key[short] = self.scan(q[short], k, kept)
        return nodes, key

    def scan(self, q: np.ndarray, k: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, keys), queries x k, padded with -1 and inf: the nearest of ``kept``, ties by their place there."""
        nodes, out = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf, np.float32)
        x = self.x[kept]
        step = max(1, min(BATCH, (16 << 20) // (max(len(kept), 1) * self.dim)))
        for a in range(0, len(q), step):
            y = q[a : a + step]
            row, col = screen(y, x, self.metric, k)
            key = exact_keys(y[row], x[col], self.metric)
            at = trim_rows(row, key, col, k)
            row, col, key = row[at], col[at], key[at]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            nodes[a + row, place], out[a + row, place] = kept[col], key
        return nodes, out

    def traced(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, list[tuple[int, int, float]], list[tuple[int, float]]]:
        """(nodes, hops, evaluated): the end point of the descent on each upper layer from the
        top on, and every node evaluated on the bottom layer in its order, with keys."""
        import heapq

        at, hops = np.array([self.entry]), []
        for layer in range(self.top, 0, -1):
            at = self.descend(q[None], at, layer)
            hops.append((layer, int(at[0]), float(self.keys(q, at)[0])))
        key = float(self.keys(q, at)[0])
        seen = np.zeros(self.n, bool)
        seen[at] = True
        todo, found, order = [(key, int(at[0]))], [(-key, -int(at[0]))], [(int(at[0]), key)]
        while todo:
            key, node = heapq.heappop(todo)
            if len(found) >= ef and key > -found[0][0]:
                break
            near = self.neighbours(node, 0)
            near = near[~seen[near]]
            seen[near] = True
            for v, c in zip(near.tolist(), self.keys(q, near).tolist()):
                order.append((v, c))
                if len(found) < ef or c < -found[0][0]:
                    heapq.heappush(todo, (c, v))
                    heapq.heappush(found, (-c, -v))
                    if len(found) > ef:
                        heapq.heappop(found)
        return np.array([v for _, v in sorted((-c, -v) for c, v in found)][:k], np.int64), hops, order

    # -- packing
    def to_bytes(self) -> dict[str, bytes]:
        """links: of every layer, the nodes on it take part with their whole padded rows."""
        parts = [self.links[layer][self.level >= layer].astype("<i4").tobytes() for layer in range(self.top + 1)]
        return {"x": self.x.astype("<f4").tobytes(), "level": self.level.astype("<i2").tobytes(), "links": b"".join(parts)}

    @classmethod
    def of(cls, row, dim: int, metric: Metric, params: HnswParams) -> Graph:
        g = cls(dim, metric, params)
        g.x = np.frombuffer(row["x"], "<f4").reshape(-1, dim)
        g.level = np.frombuffer(row["level"], "<i2").astype(np.int64)
        flat, at, g.links = np.frombuffer(row["links"], "<i4"), 0, []
        for layer in range(max(g.top, 0) + 1):
            on, cap = g.level >= layer, g.cap(layer)
            full = np.full((g.n, cap), -1, np.int32)
            full[on] = flat[at : at + int(on.sum()) * cap].reshape(-1, cap)
            at += int(on.sum()) * cap
            g.links.append(full)
        return g


def _pad(r: np.ndarray, new: np.ndarray, k: np.ndarray, rows: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by ascending row as matrices over the live rows, padded with -1 and inf."""
    n = np.bincount(r, minlength=rows)
    start = np.cumsum(n) - n
    place = np.empty(rows, np.int64)
    place[live] = np.arange(len(live))
    ids, keys = np.full((len(live), int(n.max(initial=0))), -1, np.int64), np.full((len(live), int(n.max(initial=0))), np.inf, np.float32)
    at = np.arange(len(r)) - start[r]
    ids[place[r], at], keys[place[r], at] = new, k
    return ids, keys


def _least(ids: np.ndarray, keys: np.ndarray, n: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The n entries of least key of every row."""
    if keys.shape[1] > n:
        at = np.argpartition(keys, n - 1, axis=1)[:, :n]
        ids, keys = np.take_along_axis(ids, at, 1), np.take_along_axis(keys, at, 1)
    if ordered:
        at = np.argsort(keys, axis=1, kind="stable")
        ids, keys = np.take_along_axis(ids, at, 1), np.take_along_axis(keys, at, 1)
    return ids, keys


def centres_of(x: np.ndarray, n: int, rng: np.random.Generator, passes: int = 8) -> np.ndarray:
    """About ``n`` k-means centres of a sample; many are found in two levels."""
    n = min(n, len(x))
    groups = n if n <= 256 else math.ceil(math.sqrt(n))
    c = x[rng.permutation(len(x))[:groups]].astype(np.float32)
    for _ in range(passes):
        near = nearest_centres(x, c, 1)[:, 0]
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros(c.shape)
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c).astype(np.float32)
    if groups == n:
        return c
    near = nearest_centres(x, c, 1)[:, 0]
    return np.concatenate([centres_of(x[near == g], max(1, round(n * (near == g).sum() / len(x))), rng, passes) for g in range(len(c)) if (near == g).any()])


def nearest_centres(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """rows x n: the nearest centres, ascending."""
    out = []
    half = (c * c).sum(1) / 2
    for a in range(0, len(x), 4096):
        d = half - x[a : a + 4096] @ c.T
        at = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
        out.append(np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


class HnswIndex:
    """Graphs over (vec_id, embedding). The graph table is lazy; stage or save it to build once."""

    def __init__(self, dim: int, metric: Metric = Metric.INNER_PRODUCT, params: HnswParams | None = None, shards: int | None = None, probes: int | None = None, shard_rows: int = SHARD_ROWS):
        """``shards``: by default as many as keep a shard at about ``shard_rows`` vectors.
        ``probes``: the centres whose shards a query visits, by default 8 and one more
        for every doubling of the centres, or all where there are fewer; searches with a
        filter then visit more (see _reach)."""
        if shards is not None and shards < 1 or probes is not None and probes < 1 or shard_rows < 1:
            raise ValueError("shards, probes and shard_rows must be at least 1")
        self.dim, self.metric, self.params = check_dim(dim), Metric.of(metric), params or HnswParams()
        self.shards, self.probes, self.shard_rows, self.auto = shards, probes, shard_rows, shards is None
        self.centres: np.ndarray | None = None
        self.parts: np.ndarray | None = None  # shards of each centre
        self.graph: DataFrame | None = None

    @staticmethod
    def shards_for(rows: int, shard_rows: int = SHARD_ROWS) -> int:
        """One shard up to ``shard_rows`` vectors; work per task then stays the same as rows grow."""
        return max(1, -(-rows // shard_rows))

    @property
    def ef_search(self) -> int:
        return self.params.ef_search

    @ef_search.setter
    def ef_search(self, ef: int) -> None:
        # 0 is taken as it is: searching uses max(ef, k)
        params = replace(self.params, ef_search=max(1, ef))
        self.params = params

    # -- building
    def _route(self):
        """x -> the matrix that centres are compared in: directions for inner products."""
        if self.metric is Metric.L2:
            return lambda x: x
        return lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def _learn(self, fresh: DataFrame) -> None:
        """Centres from a bounded sample, and into how many shards each is cut.

        A centre may attract a third of all rows; it then has several shards, all of
        which its queries visit, so no task grows with the hottest centre.
        """
        rows = fresh.count()
        shards = self.shards or self.shards_for(rows, self.shard_rows)
        if shards == 1:
            self.shards, self.centres, self.parts = 1, np.zeros((1, self.dim), np.float32), np.ones(1, np.int64)
            return
        n = min(shards, MOST_CENTRES)
        got = fresh.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(CENTRE_SAMPLE, 256 * n)).select("x").collect()  # bounded: CENTRE_SAMPLE rows
        way = self._route()
        sample = way(to_matrix([bytes(r[0]) for r in got], self.dim))
        self.centres = centres_of(sample, n, np.random.default_rng(self.params.seed))
        counts = {r["centre"]: r["n"] for r in self._dealt(fresh).groupBy("centre").agg(F.count("*").alias("n")).collect()}  # one row a centre
        self.parts = np.array([max(1, round(counts.get(i, 0) / self.shard_rows)) if rows > shards * self.shard_rows // 2 else 1 for i in range(len(self.centres))], np.int64)
        self.shards = int(self.parts.sum())

    def _dealt(self, fresh: DataFrame) -> DataFrame:
        centres, way, dim = self.centres, self._route(), self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                yield d.assign(centre=nearest_centres(way(to_matrix(d["x"], dim)), centres, 1)[:, 0].astype(np.int32) if len(d) else np.empty(0, np.int32))

        return fresh.mapInPandas(run, "vec_id long, x binary, centre int")

    def add(self, vectors: DataFrame) -> HnswIndex:
        """Inserts (vec_id, embedding) in vec_id order after what is there.

        ids must be new. Shards with new rows are extended, the others stay as they are; where
        that would make shards twice as large as they should be, all are dealt and built
        anew (unless ``shards`` was given). An empty table leaves the index without a vector.
        """
        if self.graph is not None and self.auto and self.size + vectors.count() > 2 * self.shards * self.shard_rows:
            vectors = self.nodes().select("vec_id", "embedding").unionByName(vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")))
            self.graph, self.centres, self.shards = None, None, None
        dim, metric, params = self.dim, self.metric, self.params
        fresh = packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")), "vec_id", "embedding", dim, "vectors")
        if self.centres is None:
            self._learn(fresh)
        first = np.cumsum(self.parts) - self.parts
        place = F.col("centre")
        if self.parts.max() > 1 or len(self.parts) > 1:
            starts, counts = (F.array(*[F.lit(int(v)) for v in a]) for a in (first, self.parts)) if len(self.parts) <= 256 else (None, None)
            if starts is not None:
                place = F.get(starts, F.col("centre")) + F.pmod(F.xxhash64("vec_id"), F.get(counts, F.col("centre")))
            else:
                table = fresh.sparkSession.createDataFrame(pd.DataFrame({"centre": np.arange(len(first)), "_f": first, "_n": self.parts}), "centre int, _f int, _n int")
                place = None
        dealt = self._dealt(fresh)
        if place is None:
            dealt = dealt.join(F.broadcast(table), "centre")  # one row a centre, at most MOST_CENTRES
            place = F.col("_f") + F.pmod(F.xxhash64("vec_id"), F.col("_n"))
        dealt = dealt.select(place.cast("int").alias("shard"), "centre", "vec_id", "x")
        if self.shards > 1:  # a task and a file for nearly every shard, which small inputs wouldn't get by themselves
            spread = min(4 * self.shards, MOST_TASKS)
            dealt = dealt.repartition(spread, "shard")

        def grown(d: pd.DataFrame, row) -> pd.DataFrame:
            g = Graph.of(row, dim, metric, params) if row is not None else Graph(dim, metric, params)
            ids = np.frombuffer(row["ids"], np.int64) if row is not None else np.empty(0, np.int64)
            d = d.sort_values("vec_id")
            shard = int(d["shard"].iloc[0])
            x = to_matrix(d["x"], dim)
            g.extend(x, levels(params.seed + shard, len(ids), len(x), params.m))
            ids = np.concatenate([ids, d["vec_id"].to_numpy(np.int64)])
            return pd.DataFrame([{"shard": shard, "centre": int(d["centre"].iloc[0]), "n": len(ids), "ids": ids.tobytes(), **g.to_bytes()}])

        if self.graph is None:
            self.graph = dealt.groupBy("shard").applyInPandas(lambda d: grown(d, None), GRAPH)
        else:

            def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                row = left.iloc[0] if len(left) else None
                return grown(right, row) if len(right) else left

            self.graph = self.graph.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(both, GRAPH)
        return self

    def add_array(self, spark: SparkSession, x: np.ndarray) -> HnswIndex:
        """Appends matrix rows under the next positions as ids."""
        x = check_array(x, self.dim)
        start = self.size
        return self.add(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(start, start + len(x)), "embedding": [v.tolist() for v in x]}), "vec_id long, embedding array<float>"))

    def staged(self) -> HnswIndex:
        """Builds now, into the session's shared folder."""
        from ..session import stage

        self.graph = stage(self._built(), "hnsw")
        return self

    def _built(self) -> DataFrame:
        if self.graph is None:
            raise ValueError("the index is empty: add vectors first")
        return self.graph

    # -- searching
    def _probes(self) -> int:
        return min(len(self.centres), self.probes or 8 + math.ceil(math.log2(len(self.centres))))

    def _reach(self, kept: DataFrame) -> tuple[np.ndarray, int]:
        """(centres with vectors that pass, how many of them a query visits): by default as many
        as hold, in the mean, as many vectors that pass as it would have in reach without a filter."""
        rows = kept.select("shard", F.size("kept").alias("n")).collect()  # one row a shard
        shard, own = (np.array([r[c] for r in rows], np.int64) for c in ("shard", "n"))
        n = np.zeros(len(self.parts), np.int64)
        np.add.at(n, np.searchsorted(np.cumsum(self.parts), shard, "right"), own)
        some, probes = np.flatnonzero(n), self._probes()
        if self.probes is None and len(some):
            probes = max(probes, math.ceil(probes * self.size / len(n) / n[some].mean()))
        return some, min(probes, len(some))

    def _dealt_queries(self, queries: DataFrame, reach: tuple[np.ndarray, int] | None = None) -> DataFrame:
        """(shard, qids, qs): the queries of every shard in packed blocks of at most QUERY_BLOCK."""
        dim, way, parts = self.dim, self._route(), self.parts
        first = np.cumsum(parts) - parts
        some, probes = reach or (np.arange(len(parts)), self._probes())
        centres = self.centres[some]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                ids, q = d["query_id"].to_numpy(np.int64), to_matrix(d["query"], dim, "queries")
                c = some[nearest_centres(way(q), centres, probes).ravel()]
                row = np.repeat(np.arange(len(q)), probes)
                many = parts[c]
                row, shard = np.repeat(row, many), np.repeat(first[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                order = np.argsort(shard, kind="stable")
                row, shard = row[order], shard[order]
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.empty(0, np.int64)
                for own in np.split(np.arange(len(shard)), cuts[1:]) if len(cuts) else ():
                    for a in range(0, len(own), QUERY_BLOCK):
                        o = own[a : a + QUERY_BLOCK]
                        yield pd.DataFrame({"shard": [int(shard[o[0]])], "qids": [ids[row[o]].tobytes()], "qs": [q[row[o]].tobytes()]})

        return queries.select("query_id", "query").mapInPandas(run, "shard int, qids binary, qs binary")

    def _run(self, queries: DataFrame, k: int, ef: int | None, where: Column | None, mask: DataFrame | Sequence[bool] | None, trace: int | None, absent: str = "error") -> DataFrame:
        from ..session import stage

        dim, metric, params = self.dim, self.metric, self.params
        beam = max(ef if ef is not None else params.ef_search, k)
        graph = self._built()
        filtered = where is not None or mask is not None
        if filtered:
            kept = masked(self.nodes(), where, mask, absent).groupBy("shard").agg(F.collect_list("vec_id").alias("kept"))  # at most a shard's rows
        reach = None
        if filtered and self._probes() < len(self.parts):
            kept = stage(kept, "kept")
            reach = self._reach(kept)
        if filtered:
            graph = graph.join(kept, "shard")
        q = self._dealt_queries(queries, reach)
        if len(self.parts) > 1:
            q = stage(q, "asked")  # its size is wanted before it is joined
            size = q.agg(F.sum(F.octet_length("qs") + F.octet_length("qids"))).first()[0] or 0
        else:
            size = queries.count() * (4 * dim + 8)
        # blocks of one shard come one after the other, so its graph is opened once a partition
        rows = graph.join(F.broadcast(q) if size <= BROADCAST_BYTES else q, "shard")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, g, names, keep = None, None, None, None
            for d in batches:
                for i in range(len(d)):
                    row = d.iloc[i]
                    if held != row["shard"]:
                        held, g, names = row["shard"], Graph.of(row, dim, metric, params), np.frombuffer(row["ids"], np.int64)
                        keep = np.isin(names, np.asarray(row["kept"], np.int64)) if filtered else None
                    yield _answers(g, names, int(held), np.frombuffer(row["qids"], np.int64), np.frombuffer(row["qs"], np.float32).reshape(-1, dim), k, beam, keep, trace)

        return rows.mapInPandas(run, RAW)

    def search(self, queries: DataFrame, k: int = 10, ef: int | None = None, where: Column | None = None, mask: DataFrame | Sequence[bool] | None = None, padded: bool = False, absent: str = "error") -> DataFrame:
        """(query_id, rank, vec_id, score). A predicate (over vec_id, level, embedding) or a mask
        (see blocks.masked) acts inside the walk of the bottom layer; where a walk would cost
        more than a scan of the vectors that pass, these are scanned (see Graph.search)."""
        raw = self._run(queries, k, ef, where, mask, None, absent) if check_k(k) else None
        found = best(raw.select("query_id", "vec_id", "key"), k, self.metric) if raw is not None else queries.sparkSession.createDataFrame([], RESULT)
        return pad(found, queries, k, self.metric) if padded else found

    def search_traced(self, queries: DataFrame, k: int = 10, max_trace: int = 40, ef: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(results, trace, visited): results unpadded; trace(query_id, shard, step,
        layer, vec_id, score) with one step for each upper layer, the end of its descent,
        and at most ``max_trace`` evenly spread evaluations of the bottom layer;
        visited(query_id, total_visited) counts all bottom-layer evaluations. k 0 gives no rows."""
        from ..functions.vectors import natural
        from ..session import stage

        spark = queries.sparkSession
        if not check_k(k):
            return spark.createDataFrame([], RESULT), spark.createDataFrame([], "query_id long, shard int, step int, layer int, vec_id long, score double"), spark.createDataFrame([], "query_id long, total_visited long")
        raw = stage(self._run(queries, k, ef, None, None, max_trace), "trace")
        trace = raw.where("kind = 'trace'").select("query_id", "shard", "step", "layer", "vec_id", natural(F.col("key"), self.metric).alias("score"))
        visited = raw.where("kind = 'visited'").groupBy("query_id").agg(F.sum("step").alias("total_visited"))
        return best(raw.where("kind = 'result'").select("query_id", "vec_id", "key"), k, self.metric), trace, visited

    # -- introspection
    def nodes(self) -> DataFrame:
        """(shard, vec_id, level, embedding)."""
        dim = self.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                for r in d.to_dict("records"):
                    x = np.frombuffer(r["x"], "<f4").reshape(-1, dim)
                    yield pd.DataFrame({"shard": r["shard"], "vec_id": np.frombuffer(r["ids"], np.int64), "level": np.frombuffer(r["level"], "<i2").astype(np.int32), "embedding": list(x)})

        return self._built().mapInPandas(run, "shard int, vec_id long, level int, embedding array<float>")

    def edges(self) -> DataFrame:
        """(shard, vec_id, level, layer, neighbors) of every node and layer."""
        dim, metric, params = self.dim, self.metric, self.params

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                for r in d.to_dict("records"):
                    g, ids = Graph.of(r, dim, metric, params), np.frombuffer(r["ids"], np.int64)
                    for layer in range(g.top + 1):
                        on = np.flatnonzero(g.level >= layer)
                        yield pd.DataFrame({"shard": r["shard"], "vec_id": ids[on], "level": g.level[on].astype(np.int32), "layer": layer, "neighbors": [ids[g.neighbours(v, layer)].tolist() for v in on]})

        return self._built().mapInPandas(run, "shard int, vec_id long, level int, layer int, neighbors array<bigint>")

    def graph_meta(self) -> DataFrame:
        """(shard, entry_point, max_level, size)."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                level = [np.frombuffer(b, "<i2") for b in d["level"]]
                yield pd.DataFrame({"shard": d["shard"], "entry_point": [int(np.frombuffer(b, np.int64)[v.argmax()]) for b, v in zip(d["ids"], level)], "max_level": [int(v.max()) for v in level], "size": d["n"]})

        return self._built().mapInPandas(run, "shard int, entry_point long, max_level int, size long")

    def violations(self) -> DataFrame:
        """One row (rule, n) per structural rule with the number of breaches."""
        own = self.edges()
        e = own.select("shard", "vec_id", "level", "layer", F.explode("neighbors").alias("to"))
        to = self.nodes().select(F.col("vec_id").alias("to"), F.col("level").alias("to_level"))
        top = self.graph_meta().join(self.nodes().select("shard", F.col("vec_id").alias("entry_point"), F.col("level").alias("entry_level")), ["shard", "entry_point"], "left")
        cap = F.when(F.col("layer") == 0, self.params.m_max0).otherwise(self.params.m)
        n = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        return (
            n(e.where("vec_id = to"), "no self-loops")
            .unionByName(n(own.where("layer > level"), "layers within the node's level"))
            .unionByName(n(e.join(to, "to").where("layer > to_level"), "links within the target's level"))
            .unionByName(n(own.where(F.size("neighbors") > cap), "links within the cap"))
            .unionByName(n(top.where("coalesce(entry_level, -1) < max_level"), "entry on the top level"))
        )

    @property
    def size(self) -> int:
        return 0 if self.graph is None else int(self.graph.agg(F.sum("n")).first()[0] or 0)

    def __len__(self) -> int:
        return self.size

    @property
    def memory_bytes(self) -> int:
        """Vectors and the room of all links, four bytes each."""
        r = self._built().agg(F.sum(F.octet_length("x").cast("long")), F.sum(F.octet_length("links").cast("long"))).first()
        return int((r[0] or 0) + (r[1] or 0))

    # -- persistence
    def save(self, path: str) -> None:
        """Writes the graphs, one row a shard, and the centres."""
        g = self._built()
        g.write.mode("overwrite").parquet(f"{path}/graph")
        spark = g.sparkSession
        rows = [(i, [float(v) for v in c], int(n)) for i, (c, n) in enumerate(zip(self.centres, self.parts))]
        spark.createDataFrame(rows, "centre int, x array<float>, shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        storage.write_json(spark, f"{path}/index.json", json.dumps({"kind": "hnsw", "dim": self.dim, "metric": self.metric.value, "shards": self.shards, "probes": self.probes, "shard_rows": self.shard_rows, "auto": self.auto, **asdict(self.params)}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HnswIndex:
        meta = storage.read_index(spark, path, "hnsw")
        index = cls(meta["dim"], Metric.of(meta["metric"]), HnswParams(meta["m"], meta["ef_construction"], meta["ef_search"], meta["seed"]), meta["shards"], meta["probes"], meta["shard_rows"])
        index.auto = meta["auto"]
        rows = spark.read.parquet(f"{path}/centres").orderBy("centre").collect()  # one row a centre
        index.centres, index.parts = np.array([r["x"] for r in rows], np.float32), np.array([r["shards"] for r in rows], np.int64)
        index.graph = spark.read.schema(GRAPH).parquet(f"{path}/graph")
        return index


def _answers(g: Graph, names: np.ndarray, shard: int, qids: np.ndarray, q: np.ndarray, k: int, beam: int, keep: np.ndarray | None, trace: int | None) -> pd.DataFrame:
    """RAW rows of one shard for a block of queries."""
    if trace is None:
        nodes, _ = g.search(q, k, beam, keep, names)
        i, j = np.nonzero(nodes >= 0)
        at = nodes[i, j]
        key = exact_keys(q[i], g.x[at], g.metric)  # the walk is in single precision
        return pd.DataFrame({"query_id": qids[i], "kind": "result", "shard": shard, "step": (j + 1).astype(np.int32), "layer": 0, "vec_id": names[at], "key": key})
    rows = []
    for qid, v in zip(qids.tolist(), q):
        at, hops, order = g.traced(v, k, beam)
        key = exact_keys(np.broadcast_to(v, (len(at), len(v))), g.x[at], g.metric)
        rows += [(qid, "result", shard, i + 1, 0, int(names[u]), float(c)) for i, (u, c) in enumerate(zip(at, key))]
        steps = [*hops, *((0, *order[i]) for i in even_positions(len(order), trace))]
        rows += [(qid, "trace", shard, i, layer, int(names[u]), c) for i, (layer, u, c) in enumerate(steps)]
        rows.append((qid, "visited", shard, len(order), 0, -1, 0.0))
    return pd.DataFrame(rows, columns=["query_id", "kind", "shard", "step", "layer", "vec_id", "key"])
