"""Filling fixed-capacity containers: shortest-pack-first over a length histogram.

Only the histogram of lengths (at most ``capacity`` entries) reaches the driver.
There the lengths are placed longest first, always into the shortest pack that
still has room; packs with the same free space are kept as intervals of container
numbers, so the state is bounded by the histogram, never by the documents. The
result is a list of *placements* (length, first rank, count, first container),
and documents find their container from their rank among the items of their
length by a binary search.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_BUCKET_ROWS = 50_000
BROADCAST_OFFSETS = 1_000_000


def plan_placements(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Shortest-pack-first. Returns placements (length, rank, count, container)
    and the number of containers.

    ``histogram`` maps lengths in 1..capacity to counts. Equal items that open
    new packs share them as one-by-one placement would: a pack takes as many of
    them as fit before the next is opened.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first container, count)]
    keys: list[int] = []
    out: list[tuple[int, int, int, int]] = []
    containers = 0

    def put(space: int, first: int, count: int) -> None:
        if space > 0 and count > 0:
            if space not in free:
                free[space] = []
                bisect.insort(keys, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, rank = int(histogram[length]), 0
        while left:
            if keys and keys[-1] >= length:
                space = keys[-1]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space]
                    keys.pop()
                k = min(left, count)
                if k < count:
                    put(space, first + k, count - k)
                out.append((length, rank, k, first))
                put(space - length, first, k)
                left, rank = left - k, rank + k
            else:
                each = capacity // length
                packs = max(1, left // each)
                fill = min(left, each)
                for _ in range(fill):
                    out.append((length, rank, packs, containers))
                    rank += packs
                put(capacity - fill * length, containers, packs)
                left -= fill * packs
                containers += packs
    return out, containers


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """(doc_id, piece_no, pieces, length): documents larger than ``capacity`` are
    cut into full pieces and a rest, all others are one piece."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size_col) / F.lit(float(capacity)))).cast("int")
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(size_col).alias("size"), n.alias("pieces"))
        .select("doc_id", "size", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_no"))
        .select("doc_id", "piece_no", "pieces", F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * capacity).cast("long").alias("length"))
    )


def rank_by_length(items: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the items of one length, in no given order.

    A length may hold a third of all rows. Lengths of more than RANK_BUCKET_ROWS items
    are salted: ranks are counted inside buckets of about that size and shifted by
    the buckets' offsets. Only those lengths have offsets, at most rows / RANK_BUCKET_ROWS
    of them in all; other lengths are one bucket each.
    """
    from pyspark.sql import Window as W

    hot = {k: -(-n // RANK_BUCKET_ROWS) for k, n in histogram.items() if n > RANK_BUCKET_ROWS}
    local = lambda x, *by: x.withColumn("rank", (F.row_number().over(W.partitionBy("length", *by).orderBy("doc_id", "piece_no")) - 1).cast("long"))
    if not hot:
        return local(items)
    salts = items.sparkSession.createDataFrame(list(hot.items()), "length long, _n int")
    x = items.join(F.broadcast(salts), "length", "left")  # a row a hot length
    x = x.withColumn("_b", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("_n"))).otherwise(0).cast("int"))
    counts = x.where("_n is not null").groupBy("length", "_b").agg(F.count("*").alias("_c"))
    before = counts.select("length", "_b", (F.sum("_c").over(W.partitionBy("length").orderBy("_b")) - F.col("_c")).alias("_off"))
    x = local(x, "_b").join(F.broadcast(before) if sum(hot.values()) <= BROADCAST_OFFSETS else before, ["length", "_b"], "left")
    return x.withColumn("rank", F.col("rank") + F.coalesce("_off", F.lit(0))).drop("_n", "_b", "_off")


def pack(docs: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """Assign every document to containers of ``capacity``.

    Returns (doc_id, piece_no, pieces, length, container). Null sizes count as
    0. Items of size 0 take no room and all lie in container 0. Documents
    with a null id are packed like others; ids need not be unique. Only documents
    larger than a container have more than one piece.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    items = pieces(sized, capacity)
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    histogram = dict(counts)
    zero = histogram.pop(0, 0)
    full = histogram.pop(capacity, 0)  # full pieces fill a container each
    places, used = plan_placements(histogram, capacity)
    places += [(capacity, 0, full, used)] if full else []
    places += [(0, 0, 0, 0)] if zero else []
    places.sort()
    # one key orders (length, rank): ranks stay under 2**40
    key = np.array([(a << 40) + b for a, b, _, _ in places], dtype=np.int64)
    start = np.array([d - b for _, b, _, d in places], dtype=np.int64)
    lengths = np.array([a for a, _, _, _ in places], dtype=np.int64)

    def lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            yield x.drop(columns="rank").assign(container=np.where(lengths[at] > 0, start[at] + rank, 0) if len(key) else 0)

    ranked = rank_by_length(items, counts).select("doc_id", "piece_no", "pieces", "length", "rank")
    return ranked.mapInPandas(lookup, "doc_id long, piece_no int, pieces int, length long, container long")


def fill(assigned: DataFrame, capacity: int) -> DataFrame:
    """(container, items, used, unused) of every container."""
    return assigned.groupBy("container").agg(F.count("*").alias("items"), F.sum("length").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
