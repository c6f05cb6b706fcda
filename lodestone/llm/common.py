"""Pieces shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_keys(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ts) of the current row of every key: the latest ``ts``.

    Rows with a null key are dropped. Only two narrow columns are shuffled and
    partial maxima are taken before the shuffle, so a hot key costs one row per
    map task.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias(ts))


def latest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The current row of every key: the one with the latest ``ts``.

    Rows repeated exactly give one row; of different rows with the same key and ts
    the one with the greatest hash counts, so the choice is the same in every run; a
    null ts counts as the earliest. Rows are shuffled once, and all but one a key and task
    are dropped before.
    """
    rest = [c for c in df.columns if c != key]
    first = W.partitionBy(key).orderBy(F.desc_nulls_last(F.col(ts).cast("timestamp")), F.desc(F.xxhash64(*rest)))
    return df.where(F.col(key).isNotNull()).withColumn("__place", F.row_number().over(first)).where(F.col("__place") == 1).drop("__place")


def in_blocks(df: DataFrame, rows: Column, id_col: str, block: int) -> DataFrame:
    """Adds _i, _lo, _hi, by which the rows of a group are paired in blocks.

    A group of ``rows`` rows is cut into blocks of about ``block`` by id hash; a row of
    block _i comes once for each other block, under the numbers of the two, _lo <= _hi.
    A self-join on the group, _lo and _hi with the condition of ``pair_once`` then meets
    every pair once, in tasks of bounded size. Small groups have one block and no copies.
    """
    n = F.greatest(F.lit(1), F.ceil(rows / F.lit(float(block)))).cast("int")
    x = df.withColumn("_n", n).withColumn("_i", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return x.withColumn("_lo", F.least("_i", "_j")).withColumn("_hi", F.greatest("_i", "_j")).drop("_n", "_j")


def pair_once(a: str, i: str, b: str, j: str) -> Column:
    """Of a self-join of blocks: ids a and b of the blocks i and j make a pair in this order."""
    return F.when(F.col("_lo") == F.col("_hi"), F.col(a) < F.col(b)).otherwise((F.col(i) == F.col("_lo")) & (F.col(j) == F.col("_hi")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns (node, root) with root the smallest node of the component, for every
    node that has an edge. Each round is a distributed aggregation and join on
    node ids whose result is staged in the shared folder, so nothing is gathered
    on the driver and a lost executor costs one round. Hubs are pre-aggregated:
    the minimum is taken by a partial aggregation and the join back is left to
    the skew handling of adaptive execution.
    """
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    was = mark(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour points to the smallest one seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself point to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        e = stage(small, "cc")
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
