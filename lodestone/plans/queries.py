"""Queries over the test tables for every operator, with SQL that checks them.

Searches ask every row whose id is divisible by EVERY against all rows. Inexact
searches run with beams and lists wide enough to find the true neighbours of all
these queries, so SQL can check their rows like those of an exact search.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import cli
from ..functions import text as T
from ..functions.embedding import encode, encode_chunked, encode_one
from ..functions.vectors import is_valid, norm, normalize
from ..operators import evaluate, storage
from ..operators.exact import ExactIndex
from ..operators.hnsw import HnswIndex, even_sample
from ..operators.pq import PqIndex
from ..operators.topk import wide
from ..session import shared_dir, stage
from ..sources import corpus, synthetic, vecsio
from ..types import FLOAT32_MAX, HnswParams, Metric, PqParams
from .semantic import SemanticSearch, display_radius, lookup

DIM = 64
L2, IP = Metric.L2, Metric.INNER_PRODUCT
#: Every row whose id is divisible by this is a query.
EVERY = 50


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _asked(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _index(base: DataFrame, metric: Metric) -> ExactIndex:
    return ExactIndex(DIM, metric, base)


def _vector(base: DataFrame, vec_id: int) -> list[float]:
    return base.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


# -- exact search ------------------------------------------------------------


def exact_ip_top10(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, IP).search_one(_vector(b, 7)))


def exact_l2_top10(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, L2).search_one(_vector(b, 7)))


def exact_batch_ip(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, IP).search(_asked(b)))


def exact_batch_l2(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, L2).search(_asked(b)))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of unequal length, on which the two metrics rank differently."""
    return _base(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).cast("array<float>"))


def exact_batch_scaled_ip(spark: SparkSession, sf: str) -> DataFrame:
    b = _scaled(spark, sf)
    return _rounded(_index(b, IP).search(_asked(b)))


def exact_batch_scaled_l2(spark: SparkSession, sf: str) -> DataFrame:
    b = _scaled(spark, sf)
    return _rounded(_index(b, L2).search(_asked(b)))


def exact_columns_l2(spark: SparkSession, sf: str) -> DataFrame:
    b = _scaled(spark, sf)
    return _rounded(_index(b, L2).search_columns(_asked(b)))


def exact_filtered_label(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, L2).search_one(_vector(b, 7), where=F.col("label") == 3))


def exact_filtered_batch(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    mask = b.select("vec_id", (F.col("vec_id") % 5 == 0).alias("keep"))
    return _rounded(_index(b, IP).search(_asked(b), mask=mask))


def exact_filtered_empty_padded(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _index(b, L2).search(_asked(b), 3, where=F.lit(False), padded=True)


def exact_pad_k_gt_n(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    x = _index(b, IP).search(_asked(b), 8, where=F.col("vec_id") < 6, padded=True)
    return x.select("query_id", "rank", "vec_id", F.when(F.col("vec_id") < 0, F.col("score")).otherwise(F.round("score", 6)).alias("score"))


def exact_k_zero(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, IP).search(_asked(b), 0))


def exact_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The wide form: ids and scores of a query in one row, as text."""
    b = _base(spark, sf)
    w = wide(_index(b, IP).search(_asked(b), 5))
    return w.select("query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("scores").alias("n"))


def exact_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return _rounded(_index(b, L2).within(_asked(b), 1.1))


def incremental_add(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf).select("vec_id", "embedding")
    index = ExactIndex(DIM, L2).add(b.where("vec_id % 2 = 0")).add(b.where("vec_id % 2 = 1"))
    return _rounded(index.search(_asked(b)))


def incremental_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without ids get the next positions."""
    b = _base(spark, sf).select("vec_id", "embedding")
    index = ExactIndex(DIM, L2).append(b.where("vec_id % 2 = 0").withColumn("o", F.col("vec_id")), "o").append(b.where("vec_id % 2 = 1").withColumn("o", F.col("vec_id")), "o")
    return index.vectors.select(F.col("o").alias("old_id"), "vec_id")


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _base(spark, sf).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).select("vec_id", F.posexplode(normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


def memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = _index(_base(spark, sf), IP)
    return spark.createDataFrame([(i.size, i.dim, i.memory_bytes, i.metric.value)], "size long, dim int, memory_bytes long, metric string")


# -- the project's own tables -------------------------------------------------


def _current(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest row of every key: one shuffle, with all but one row a key and task dropped before it."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts)))).where("_r = 1").drop("_r")


def _valid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Current valid vectors at unit length."""
    v = _current(_t(spark, sf, "vectors"), "vec_id", "embedded_at")
    v = v.where(is_valid(F.col("embedding"), DIM) & F.exists("embedding", lambda x: x != 0))
    return v.select("vec_id", "category", normalize(F.col("embedding")).cast("array<double>").alias("embedding"))


def _valid_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = _t(spark, sf, "query_vectors").where(is_valid(F.col("query"), DIM) & F.col("metric").isin(*[m.value for m in Metric]))
    return q.select("query_id", "query", "k", "metric")


def _searched(spark: SparkSession, sf: str, mask: DataFrame | None = None) -> DataFrame:
    """The stored queries, each by its own metric and with its own k."""
    q = _valid_queries(spark, sf)
    base = stage(_valid_vectors(spark, sf).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), "unit")
    most = {r["metric"]: r["k"] for r in q.groupBy("metric").agg(F.max("k").alias("k")).collect()}  # one row a metric
    found = None
    for m in Metric:
        own = q.where(F.col("metric") == m.value)
        x = ExactIndex(DIM, m, base).search(own, max(most.get(m.value) or 0, 0), mask=mask, absent="drop").join(own.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")
        found = x if found is None else found.unionByName(x)
    return found


def vectors_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every valid stored query against all valid current vectors, k as the query asks."""
    return _searched(spark, sf).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def vectors_search_masked(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf, _t(spark, sf, "vec_mask")).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def vectors_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Current vectors by what is wrong with them."""
    e = F.col("embedding")
    why = (
        F.when(e.isNull(), "null").when(F.size(e) != DIM, "size").when(F.exists(e, lambda x: x.isNull()), "null element")
        .when(~is_valid(e, DIM), "not finite").when(~F.exists(e, lambda x: x != 0), "all zero").otherwise("valid")
    )
    return _current(_t(spark, sf, "vectors"), "vec_id", "embedded_at").groupBy(why.alias("state")).agg(F.count("*").alias("n"))


def stored_hits_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the stored search against exact search, over the valid queries."""
    q = _valid_queries(spark, sf)
    r = evaluate.recall(_t(spark, sf, "search_hits").select("query_id", "vec_id"), _searched(spark, sf), q)
    return r.select(F.round("recall", 4).alias("recall"), "queries")


def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each bundle: the manifest's count, the documents and vectors there are, whether the count holds."""
    docs = _current(_t(spark, sf, "doc_meta"), "id", "ingested_at").groupBy("bundle").agg(F.count("*").alias("docs"))
    vecs = _current(_t(spark, sf, "vectors"), "vec_id", "embedded_at").groupBy("bundle").agg(F.count("*").alias("vectors"))
    x = _t(spark, sf, "corpus_manifest").join(docs, "bundle", "left").join(vecs, "bundle", "left").fillna({"docs": 0, "vectors": 0})
    return x.select("bundle", "count", "docs", "vectors", F.coalesce(F.col("count") == F.col("docs"), F.lit(False)).alias("holds"), F.coalesce(F.col("metric").isin(*[m.value for m in Metric]), F.lit(False)).alias("known_metric"))


# -- evaluation ---------------------------------------------------------------


def heldout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a random split, the ids there are in both parts together, and the base's highest new id."""
    base, q = evaluate.held_out(_base(spark, sf), 40)
    ids = base.select(F.col("old_id").alias("id"), "vec_id").unionByName(q.select(F.col("query_id").alias("id"), F.lit(None).cast("long").alias("vec_id")))
    return ids.agg(F.count("vec_id").alias("base"), F.sum(F.col("vec_id").isNull().cast("long")).alias("queries"), F.countDistinct("id").alias("ids"), F.countDistinct("vec_id").alias("dense"), F.max("vec_id").alias("top"))


def heldout_order(spark: SparkSession, sf: str) -> DataFrame:
    """The base's new ids go up with the old ones: each new id with the number of base rows before it."""
    base, _ = evaluate.held_out(_base(spark, sf), 40)
    x = stage(base.select("old_id", "vec_id"), "base")
    return x.select((F.row_number().over(W.orderBy("old_id")) - 1).cast("long").alias("place"), "vec_id")


def builder_sample(spark: SparkSession, sf: str) -> DataFrame:
    x = evaluate.builder_sample(_base(spark, sf), 100).join(_base(spark, sf).select(F.col("vec_id").alias("own")), F.col("vec_id") == F.col("own"))
    return x.agg(F.count("*").alias("rows"), F.countDistinct("vec_id").alias("ids"))


def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    return evaluate.ground_truth(_index(b, L2), _asked(b), 10).select("query_id", "rank", "vec_id")


def ground_truth_of_cut_base(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped neighbours for the whole base, new ones for a base that was cut."""
    b = _base(spark, sf)
    q = _asked(b)
    shipped = evaluate.ground_truth(_index(b, IP), q, 20)
    cut = evaluate.truth_of(b.where("label < 5"), q, IP, DIM, 10, shipped, True)
    return evaluate.truth_of(b, q, IP, DIM, 10, shipped).select("query_id", "rank", "vec_id").withColumn("cut", F.lit(False)).unionByName(cut.withColumn("cut", F.lit(True)))


def _parity(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A truth, an answer that only looks at even ids, and the queries."""
    b = _base(spark, sf)
    q = _asked(b)
    return _index(b, IP).search(q), _index(b, IP).search(q, where=F.col("vec_id") % 2 == 0), q


def recall_harness(spark: SparkSession, sf: str) -> DataFrame:
    truth, found, q = _parity(spark, sf)
    return evaluate.recall(found, truth, q).select(F.round("recall", 6).alias("recall"), "queries")


def recall_tests(spark: SparkSession, sf: str) -> DataFrame:
    truth, found, q = _parity(spark, sf)
    n = q.count()
    return evaluate.recall_at(found, truth, n, 10).select(F.round("recall", 6).alias("recall"), F.lit(n).cast("long").alias("queries"))


def plan_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Places that matrix products in tasks and pure column expressions fill alike."""
    b = _base(spark, sf)
    q = _asked(b)
    i = _index(b, L2)
    n = q.count()
    x = i.search(q).select("query_id", "rank", "vec_id").join(i.search_columns(q).select("query_id", "rank", "vec_id"), ["query_id", "rank", "vec_id"])
    share = evaluate.agreement(i.search(q), i.search_columns(q), n, 10)
    return x.groupBy("query_id").agg(F.count("*").alias("alike")).withColumn("share", F.lit(round(share.first()["recall"], 6)))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    x = evaluate.percentiles(_t(spark, sf, "events"), "value")
    return x.select(*[F.round(c, 6).alias(c) for c in ("p50", "p99", "mean")])


def nan_last(spark: SparkSession, sf: str) -> DataFrame:
    """First elements of all embeddings in ascending order: NaN comes last."""
    x = _current(_t(spark, sf, "vectors"), "vec_id", "embedded_at").select("vec_id", F.get("embedding", F.lit(0)).alias("x")).where("x is not null")
    return x.select("vec_id", F.row_number().over(W.orderBy("x", "vec_id")).alias("place"))


def bench_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Figures as the bench's table shows them."""
    cell = F.pandas_udf(lambda v: pd.Series([evaluate.shown(None if pd.isna(x) else float(x)) for x in v], dtype=object), "string")
    whole = F.pandas_udf(lambda v: pd.Series([evaluate.shown(int(x)) for x in v], dtype=object), "string")
    x = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 1024).alias("v"))
    return x.select("o_orderkey", cell("v").alias("cell"), whole("o_orderkey").alias("key"))


def even_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """7 evenly spread members of 0 .. label * 5."""
    b = _base(spark, sf).select("vec_id", F.sequence(F.lit(0), F.col("label").cast("int") * 5).alias("a"))
    return b.select("vec_id", F.posexplode(even_sample(F.col("a"), 7)).alias("i", "x"))


# -- product quantization -------------------------------------------------------


def _fixed_pq(spark: SparkSession, sf: str, metric: Metric) -> tuple[PqIndex, DataFrame]:
    """Codebooks made of the subvectors of vectors 0 .. 15."""
    b = _base(spark, sf)
    rows = b.where("vec_id < 16").orderBy("vec_id").select("embedding").collect()
    p = PqParams(m=4, nbits=4)
    books = np.array([r[0] for r in rows], np.float32).reshape(16, 4, 16).transpose(1, 0, 2)
    return PqIndex(DIM, metric, p).use_codebooks(books), b


def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    index, b = _fixed_pq(spark, sf, L2)
    code = F.conv(F.hex(F.expr("substring(code, i + 1, 1)")), 16, 10).cast("int")
    return index.encode(b.select("vec_id", "embedding")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("vec_id", F.col("i").alias("sub"), code.alias("code"))


def pq_search_l2(spark: SparkSession, sf: str) -> DataFrame:
    index, b = _fixed_pq(spark, sf, L2)
    return _pq_scores(index.add(b).search(_asked(b)))


def pq_search_ip(spark: SparkSession, sf: str) -> DataFrame:
    index, b = _fixed_pq(spark, sf, IP)
    return _pq_scores(index.add(b).search(_asked(b)))


def pq_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    index, b = _fixed_pq(spark, sf, L2)
    return _pq_scores(index.add(b).search(_asked(b), where=F.col("label") == 2))


def _pq_scores(found: DataFrame) -> DataFrame:
    """Ranked scores; many vectors share a code, so which of equals comes in is left out."""
    return found.select("query_id", "rank", F.round("score", 5).alias("score"))


def _unit(spark: SparkSession, sf: str) -> DataFrame:
    """Valid current vectors at unit length, as floats."""
    return _valid_vectors(spark, sf).select("vec_id", "category", F.col("embedding").cast("array<float>").alias("embedding"))


def _neighbours(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def pq_trained(spark: SparkSession, sf: str) -> DataFrame:
    """Trained codes of 16 bytes: the true 10 neighbours are among the 150 nearest by code."""
    b = stage(_unit(spark, sf), "unit")
    index = PqIndex(DIM, IP, PqParams(m=16)).train(b).add(b)
    return _neighbours(index.search_reranked(_asked(b), b, 10, 15))


def pq_trained_on_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The same in L2, with codebooks from a sample drawn with replacement."""
    b = stage(_unit(spark, sf), "unit")
    index = PqIndex(DIM, L2, PqParams(m=16, train_sample=700)).train(b).add(b)
    return _neighbours(index.search_reranked(_asked(b), b, 10, 15))


def pq_trained_masked(spark: SparkSession, sf: str) -> DataFrame:
    b = stage(_unit(spark, sf), "unit")
    index = PqIndex(DIM, IP, PqParams(m=16, train_iters=10)).train(b).add(b)
    mask = b.select("vec_id", (F.col("vec_id") % 3 == 0).alias("keep"))
    return _neighbours(index.search_reranked(_asked(b), b, 10, 15, mask=mask))


def pq_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters, size and memory of a trained index, and what is left after training anew."""
    b = _base(spark, sf)
    rows = []
    for m, nbits in ((4, 4), (8, 6), (16, 8)):
        i = PqIndex(DIM, L2, PqParams(m=m, nbits=nbits, train_iters=2))
        before = i.is_trained
        i.train(b).add(b)
        full = (len(i), i.memory_bytes, i.raw_bytes, round(i.compression_ratio, 4))
        i.train(b)  # drops the codes
        rows.append((m, nbits, i.sub, before, i.is_trained, *full, len(i), i.compression_ratio))
    return spark.createDataFrame(rows, "m int, nbits int, sub_dim int, trained_before boolean, trained_after boolean, size long, memory_bytes long, raw_bytes long, ratio double, size_after_retraining long, ratio_after double")


# -- graphs ---------------------------------------------------------------------


def _graph(base: DataFrame, metric: Metric = IP, **own) -> HnswIndex:
    """Shards of the default size."""
    return HnswIndex(DIM, metric, HnswParams(**own)).add(base.select("vec_id", "embedding")).staged()


def hnsw_search(spark: SparkSession, sf: str) -> DataFrame:
    b = stage(_unit(spark, sf), "unit")
    return _neighbours(_graph(b).search(_asked(b), 10, ef=200))


def hnsw_search_l2(spark: SparkSession, sf: str) -> DataFrame:
    b = stage(_unit(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.col("vec_id") % 3).cast("float"))), "scaled")
    return _neighbours(_graph(b, L2).search(_asked(b), 10, ef=200))


def hnsw_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A mask that a fifth of the vectors pass acts inside the walk, or on a scan of these where that is faster."""
    b = stage(_unit(spark, sf), "unit")
    mask = b.select("vec_id", (F.col("vec_id") % 5 == 0).alias("keep"))
    return _neighbours(_graph(b).search(_asked(b), 10, ef=200, mask=mask))


def hnsw_search_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Hardly any vector passes, and places are padded."""
    b = stage(_unit(spark, sf), "unit")
    x = _graph(b).search(_asked(b), 10, ef=100, where=F.col("vec_id") % 200 == 7, padded=True)
    return x.select("query_id", "rank", "vec_id", F.when(F.col("vec_id") >= 0, F.round("score", 4)).otherwise(F.col("score")).alias("score"))


def hnsw_sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of 200 vectors by nearest centre, of which a query visits those of 6 centres and more."""
    b = stage(_unit(spark, sf), "unit")
    index = HnswIndex(DIM, IP, HnswParams(ef_construction=100), shard_rows=200, probes=12).add(b.select("vec_id", "embedding")).staged()
    return _neighbours(index.search(_asked(b), 3, ef=100))


def hnsw_grown(spark: SparkSession, sf: str) -> DataFrame:
    """A graph that grew in two steps."""
    b = stage(_unit(spark, sf), "unit")
    x = b.select("vec_id", "embedding")
    index = HnswIndex(DIM, IP).add(x.where("vec_id % 3 <> 0")).staged().add(x.where("vec_id % 3 = 0")).staged()
    return _neighbours(index.search(_asked(b), 10, ef=200))


def hnsw_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Of every node its level, its layers, and links to itself, above a target's level, and beyond the cap."""
    index = _graph(_base(spark, sf), L2, m=8, ef_construction=60)
    e = index.edges()
    cap = F.when(F.col("layer") == 0, index.params.m_max0).otherwise(index.params.m)
    own = e.groupBy("vec_id", "level").agg(F.count("*").alias("layers"), F.sum(F.array_contains("neighbors", F.col("vec_id")).cast("long")).alias("self_links"), F.sum((F.size("neighbors") > cap).cast("long")).alias("over_cap"))
    to = index.nodes().select(F.col("vec_id").alias("to"), F.col("level").alias("to_level"))
    high = e.select("vec_id", "layer", F.explode("neighbors").alias("to")).join(to, "to").where("layer > to_level").groupBy("vec_id").agg(F.count("*").alias("above"))
    return own.join(high, "vec_id", "left").fillna({"above": 0})


def hnsw_entry(spark: SparkSession, sf: str) -> DataFrame:
    """The entry point: the first node of the highest level."""
    return _graph(_base(spark, sf), L2, m=8, ef_construction=60).graph_meta().select("entry_point", "max_level", "size")


def hnsw_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(_base(spark, sf), IP, ef_construction=100).violations()


def hnsw_memory(spark: SparkSession, sf: str) -> DataFrame:
    index = _graph(_base(spark, sf), L2, m=8, ef_construction=60)
    index.ef_search = 0
    low = index.ef_search
    index.ef_search = 77
    return spark.createDataFrame([(len(index), index.memory_bytes, index.params.m_max0, low, index.ef_search)], "size long, memory_bytes long, m_max0 int, least_ef int, ef int")


def hnsw_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Steps a layer: one for every upper layer, ten of the bottom layer's evaluations."""
    b = _base(spark, sf)
    _, trace, _ = _graph(b, L2, m=8, ef_construction=60).search_traced(_asked(b), 5, max_trace=10, ef=100)
    return trace.groupBy("query_id", "layer").agg(F.count("*").alias("steps"), F.countDistinct("step").alias("places"))


def hnsw_trace_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Without a cap the bottom layer's steps are all that were visited; the results are those of a search."""
    b = _base(spark, sf)
    found, trace, visited = _graph(b, L2, m=8, ef_construction=60).search_traced(_asked(b), 5, max_trace=1_000_000, ef=200)
    n = trace.where("layer = 0").groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("d")).join(visited, "query_id")
    missed = n.select("query_id", (F.col("n") - F.col("total_visited")).alias("not_traced"), (F.col("n") - F.col("d")).alias("twice"))
    return _rounded(found).join(missed, "query_id")


# -- texts ------------------------------------------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _current(_t(spark, sf, "doc_meta"), "id", "ingested_at").select("id", "title", "text", "url")


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    x = _docs(spark, sf).select("id", T.normalize_whitespace(F.col("text")).alias("t"))
    return x.select("id", F.coalesce(F.length("t"), F.lit(-1)).alias("n"), F.md5("t").alias("digest"))


def text_min_length(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(T.long_enough(F.col("text"), 200)).select("id")


def text_snippet(spark: SparkSession, sf: str) -> DataFrame:
    x = T.trim_snippet(T.normalize_whitespace(F.col("text")), 120, False)
    return _docs(spark, sf).select("id", x.alias("snippet"))


def text_snippet_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of texts that were cut at 300 characters before."""
    x = T.trim_snippet(F.substring(F.col("text"), 1, 300), 300, True)
    return _docs(spark, sf).select("id", x.alias("snippet"))


def text_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", F.md5(T.embed_text(F.col("title"), F.col("text"))).alias("digest"), T.default_url(F.col("url")).alias("url"))


def corpus_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records to corpus documents: normalized, long enough, dense ids, snippets."""
    x = corpus.take_documents(_docs(spark, sf), "id", 2**62, 500, 200)
    return x.select("id", "title", F.md5("text").alias("digest"), "url")


def corpus_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first 30 documents that are long enough."""
    return corpus.take_documents(_docs(spark, sf), "id", 30, 500, 400).select("id", "title", F.md5("text").alias("digest"))


class Letters:
    """An embedder that SQL can follow: shares of the letters a to z, at unit length."""

    dim = 26

    def encode(self, texts: list[str]) -> np.ndarray:
        x = np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], np.float64).reshape(-1, 26)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32)


def _library(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(documents, vectors) of all current records with title and text."""
    docs = stage(_docs(spark, sf).where("title is not null and text is not null").withColumn("url", T.default_url(F.col("url"))), "docs")
    v = encode(docs.select(F.col("id").alias("vec_id"), T.embed_text(F.col("title"), F.col("text")).alias("t")), "t", Letters())
    return docs, stage(v.select("vec_id", "embedding"), "letters")


def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    _, v = _library(spark, sf)
    return _cells(v, 5)


def embed_on_the_driver(spark: SparkSession, sf: str) -> DataFrame:
    """The query texts in chunks of 7, and one by one."""
    asked = [(r["id"], r["t"]) for r in _library(spark, sf)[0].where(F.col("id") % EVERY == 0).select("id", T.embed_text(F.col("title"), F.col("text")).alias("t")).collect()]  # the queries
    seen: list[tuple[int, int]] = []
    many = encode_chunked(Letters(), [t for _, t in asked], 7, lambda done, total: seen.append((done, total)))
    rows = [(i, float(m @ np.arange(26)), float(encode_one(Letters(), t) @ np.arange(26)), len(seen)) for (i, t), m in zip(asked, many)]
    return spark.createDataFrame(rows, "id long, chunked double, single double, calls long").select("id", F.round("chunked", 3).alias("chunked"), F.round("single", 3).alias("single"), "calls")


# -- semantic search ------------------------------------------------------------------


def semantic_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Stored queries to ranked documents: search, padded places dropped, title and snippet looked up."""
    x = lookup(_searched(spark, sf), _docs(spark, sf), 80)
    return x.select("query_id", "rank", "id", "title", F.col("text").alias("snippet"))


def score_radius(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    x = display_radius(_index(b, IP).search(_asked(b)), IP)
    return x.select("query_id", "rank", F.round("radius", 5).alias("radius"))


def _asked_texts(docs: DataFrame) -> tuple[list[int], list[str]]:
    rows = docs.where(F.col("id") % EVERY == 0).select("id", T.embed_text(F.col("title"), F.col("text")).alias("t")).orderBy("id").collect()  # the queries
    return [r["id"] for r in rows], [r["t"] for r in rows]


def semantic_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to ranked documents; snippets by the manifest's word on whether they were cut before."""
    docs, v = _library(spark, sf)
    _, texts = _asked_texts(docs)
    out = None
    for clean in (True, False):
        s = SemanticSearch(ExactIndex(26, IP, v), docs, Letters(), {"snippet_chars": 60, "clean_snippets": clean})
        x = s.query_many(texts, 5).withColumn("clean", F.lit(clean))
        out = x if out is None else out.unionByName(x)
    return out.select("clean", "query_id", "rank", F.round("score", 4).alias("score"), "id", "title", F.col("text").alias("snippet"), "url")


def semantic_traced(spark: SparkSession, sf: str) -> DataFrame:
    """One query on a graph: the first hit, and a step for each upper layer and five of the bottom one."""
    docs, v = _library(spark, sf)
    _, texts = _asked_texts(docs)
    graph = HnswIndex(26, IP, HnswParams(m=8, ef_search=200)).add(v).staged()
    found, steps, visited, _ = SemanticSearch(graph, docs, Letters(), {}).query_traced(texts[-1], 5, 5)
    titles = sum(x["title"] is not None for x in steps)
    return spark.createDataFrame([(r["rank"], r["id"], sum(x["layer"] > 0 for x in steps), sum(x["layer"] == 0 for x in steps), titles == len(steps) and visited >= 5) for r in found], "rank int, id long, upper int, bottom int, titled boolean")


def semantic_info(spark: SparkSession, sf: str) -> DataFrame:
    """What a service reports of a saved corpus with and without a stored graph; its metric is the default one."""
    docs, v = _library(spark, sf)
    path = _saved(spark, docs, v, "letters", 26)
    rows = [SemanticSearch.from_corpus(spark, path, Letters()).info()]
    HnswIndex(26, IP, HnswParams(m=8)).add(v).save(f"{path}/hnsw")
    for graph in (True, False):
        s = SemanticSearch.from_corpus(spark, path, Letters(), prefer_hnsw=graph)
        rows.append(s.info())
    # a graph's memory holds its links too
    rows[1] = rows[1].withColumn("memory_mb", F.when(F.col("memory_mb") > F.round(F.col("count") * 104 / 1e6, 1), F.round(F.col("count") * 104 / 1e6, 1)))
    warm = s.warm_up([r["r_name"] for r in _t(spark, sf, "region").collect()])  # a fixed table of five rows
    kinds = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return kinds.groupBy("count", "dim", "model", "metric", "index_kind", "memory_mb").agg(F.count("*").alias("n")).withColumn("warmed", F.lit(warm))


# -- files ------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, docs: DataFrame, vectors: DataFrame, model: str, dim: int) -> str:
    path = _folder(spark, "corpus")
    corpus.save_corpus(path, vectors, docs, corpus.manifest_of(docs.count(), dim, model, IP, 60, True))
    return path


def corpus_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Save, pick among candidates, load: documents, vectors and manifest come back."""
    docs, v = _library(spark, sf)
    path = corpus.pick_corpus(spark, [_folder(spark, "none"), _saved(spark, docs, v, "letters", 26)])
    vectors, back, m = corpus.load_corpus(spark, path)
    only, _ = corpus.load_metadata(spark, path)
    x = back.join(only.select("id", F.length("text").alias("n")), "id").join(vectors.withColumnRenamed("vec_id", "id"), "id")
    return x.select("id", "title", F.md5("text").alias("digest"), "url", "n", F.round(F.get("embedding", F.lit(4)).cast("double"), 5).alias("e"), F.lit(m["count"]).cast("long").alias("count"), F.lit(m["model"]).alias("model"), F.lit(m["metric"]).alias("metric"))


def file_npy(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "npy")
    storage.write_json(spark, f"{path}/made", "{}")
    corpus.write_npy(_base(spark, sf), f"{path}/vectors.npy", DIM)
    return _cells(corpus.read_npy(spark, f"{path}/vectors.npy", 128))


def _cells(v: DataFrame, digits: int = 6) -> DataFrame:
    return v.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), digits).alias("x"))


def file_fvecs(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "fvecs")
    storage.write_json(spark, f"{path}/made", "{}")
    vecsio.write_fvecs(_base(spark, sf), f"{path}/x.fvecs", DIM)
    return _cells(vecsio.read_fvecs(spark, f"{path}/x.fvecs", 100))


def file_sift(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of base, queries (fvecs) and neighbours (ivecs): the neighbours as they are shipped."""
    b = _base(spark, sf)
    q = _asked(b)
    path = _folder(spark, "sift")
    storage.write_json(spark, f"{path}/made", "{}")
    vecsio.write_fvecs(b, f"{path}/sift_base.fvecs", DIM)
    vecsio.write_fvecs(q.toDF("vec_id", "embedding"), f"{path}/sift_query.fvecs", DIM)
    ids = wide(_index(b, L2).search(q, 10)).orderBy("query_id").collect()  # the queries
    vecsio.write_vecs(f"{path}/sift_groundtruth.ivecs", np.array([r["ids"] for r in ids], np.int32))
    s = vecsio.load_sift(spark, path)
    return s.ground_truth.join(s.queries.select("query_id"), "query_id").join(s.base.select("vec_id"), "vec_id").select("query_id", "rank", "vec_id")


def index_saved_exact(spark: SparkSession, sf: str) -> DataFrame:
    b = _base(spark, sf)
    path = _folder(spark, "exact")
    _index(b, L2).save(path)
    i = ExactIndex.load(spark, path)
    return _rounded(i.search(_asked(b))).withColumn("metric", F.lit(i.metric.value))


def index_saved_pq(spark: SparkSession, sf: str) -> DataFrame:
    index, b = _fixed_pq(spark, sf, L2)
    path = _folder(spark, "pq")
    index.add(b).save(path)
    return _pq_scores(PqIndex.load(spark, path).search(_asked(b)))


def index_saved_hnsw(spark: SparkSession, sf: str) -> DataFrame:
    b = stage(_unit(spark, sf), "unit")
    path = _folder(spark, "hnsw")
    HnswIndex(DIM, IP, HnswParams(ef_search=200)).add(b.select("vec_id", "embedding")).save(path)
    return _neighbours(HnswIndex.load(spark, path).search(_asked(b)))


def array_source(spark: SparkSession, sf: str) -> DataFrame:
    """A matrix in column order under positions as ids."""
    b = _base(spark, sf)
    x = np.array([r["query"] for r in _asked(b).orderBy("query_id").collect()], np.float32)  # the queries
    return ExactIndex(DIM, L2).add_array(spark, np.asfortranarray(x)).search(_asked(b), 3).select("query_id", "rank", "vec_id", F.round("score", 5).alias("score"))


def generated_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(synthetic.uniform(spark, 300, 16, 9))


def generated_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(synthetic.gaussian_unit(spark, 300, 16, 9), 4)


def graph_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of the first 5,000 nodes for three m."""
    from ..operators.hnsw import levels

    rows = [(m, HnswParams(m=m).m_max0, i, int(v)) for m in (2, 8, 16) for i, v in enumerate(levels(HnswParams().seed, 0, 5000, m))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["m", "m_max0", "node", "level"]))


# -- jobs ---------------------------------------------------------------------------------


def _job_corpus(spark: SparkSession, sf: str) -> str:
    path = _folder(spark, "job")
    cli.main(["build-corpus", f"{sf}/documents.parquet", path, "--order-by", "doc_id", "--model", "hashing-16", "--snippet-chars", "90", "--min-chars", "300"])
    return path


def job_corpus(spark: SparkSession, sf: str) -> DataFrame:
    vectors, docs, m = corpus.load_corpus(spark, _job_corpus(spark, sf))
    x = docs.join(vectors.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 3).alias("norm")), "id")
    return x.select("id", "title", F.md5("text").alias("digest"), "url", "dim", "norm", F.lit(m["count"]).cast("long").alias("count"))


def job_indexes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the three kinds of index that the job builds of one corpus."""
    path = _job_corpus(spark, sf)
    for kind in ("exact", "pq", "hnsw"):
        cli.main(["build-index", path, "--type", kind, "--m", "4"])
    rows = [("exact", len(ExactIndex.load(spark, f"{path}/exact"))), ("pq", len(PqIndex.load(spark, f"{path}/pq"))), ("hnsw", len(HnswIndex.load(spark, f"{path}/hnsw")))]
    return spark.createDataFrame(rows, "kind string, size long")


def job_bench(spark: SparkSession, sf: str) -> DataFrame:
    """The bench's report on generated vectors: what was measured, on how many, and the recall of the exact search."""
    out = _folder(spark, "report") + ".json"
    cli.main(["bench", "--synthetic", "600", "16", "--queries", "20", "--ef", "16,600", "--pq-m", "4", "--passes", "1", "--latency-samples", "2", "--out", out])
    report = json.loads(storage.read_text(spark, out))
    rows = [(r["name"], r["n"], r["dim"], r["k"], r["memory_mb"] * 1e6 if r["name"].startswith(("exact", "pq")) else None, r["recall"] if r["name"] in ("exact", "hnsw(ef=600)") else None, min(r["p50_ms"], r["qps_1t"], r["qps_mt"]) > 0, report["provenance"]["cpus"] > 0) for r in report["results"]]
    return spark.createDataFrame(rows, "name string, n long, dim int, k int, memory double, recall double, timed boolean, known_host boolean")


_OWN = {"queries", "classes"}


def queries() -> dict:
    here = __name__
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == here and k not in _OWN and k.islower()}


# -- SQL ----------------------------------------------------------------------------

_E = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"
_SCALED = "SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE * (1 + label))::FLOAT)::DOUBLE[] AS v FROM embeddings"


def _sql_batch(metric: Metric, base: str = _E, k: int = 10, where: str = "true", score_digits: int = 6) -> str:
    d = "list_distance(q.v, b.v)" if metric is L2 else "-list_inner_product(q.v, b.v)"
    s = "d" if metric is L2 else "-d"
    return f"""WITH b AS ({base}), s AS (SELECT q.vec_id AS query_id, b.vec_id, {d} AS d FROM b AS q, b WHERE q.vec_id % {EVERY} = 0 AND ({where})),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, round({s}, {score_digits}) AS score FROM r WHERE rank <= {k}"""


def _sql_one(metric: Metric, where: str = "true") -> str:
    return f"SELECT 0 AS query_id, rank, vec_id, score FROM ({_sql_batch(metric, where=where).replace(f'q.vec_id % {EVERY} = 0', 'q.vec_id = 7')})"


_VALID = """v0 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) AS r FROM vectors),
        v1 AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM v0 WHERE r = 1 AND embedding IS NOT NULL AND len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        v AS (SELECT vec_id, list_transform(e, lambda x: (x / sqrt(list_inner_product(e, e)))::FLOAT)::DOUBLE[] AS e FROM v1),
        q AS (SELECT query_id, query::DOUBLE[] AS e, k, metric FROM query_vectors WHERE query IS NOT NULL AND len(query) = 64
            AND len(list_filter(query, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND metric IN ('L2', 'InnerProduct')),
        s AS (SELECT query_id, vec_id, k, CASE metric WHEN 'L2' THEN list_distance(q.e, v.e) ELSE -list_inner_product(q.e, v.e) END AS key, CASE metric WHEN 'L2' THEN 1 ELSE -1 END AS sign FROM q, v WHERE {where}),
        f AS (SELECT query_id, vec_id, sign * key AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, vec_id) AS rank FROM s) WHERE rank <= k)"""

_DOCS = "SELECT id, title, text, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM doc_meta) WHERE r = 1"
_SPACES = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORMAL = f"trim(regexp_replace(text, '{_SPACES}+', ' ', 'g'))"


def _sql_snippet(text: str, m: int, cut: bool, id_cols: str, source: str) -> str:
    return f"""WITH a AS (SELECT {id_cols}, {text} AS t FROM ({source})),
        b AS (SELECT *, regexp_replace(substr(t, 1, {m}), '{_SPACES}+$', '') AS c FROM a),
        d AS (SELECT *, right(c, 1) AS z, length(c) - strpos(reverse(c), ' ') AS p, strpos(c, ' ') AS has FROM b),
        e AS (SELECT *, CASE WHEN NOT contains(' ,;:"'')]}}', z) AND has > 0 AND p > 0.6 * {m} THEN substr(c, 1, p) ELSE c END AS w FROM d),
        f AS (SELECT *, rtrim(w, ' ,;:') AS y FROM e)
        SELECT {id_cols}, CASE WHEN t IS NULL THEN NULL WHEN length(t) < {m} OR (length(t) = {m} AND NOT {str(cut).lower()}) THEN t WHEN length(c) = 0 OR z IN ('.', '!', '?', '…') THEN c
            ELSE substr(y, 1, {m - 1}) || '…' END AS snippet FROM f"""


_PQ = """b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        sub AS (SELECT vec_id, label, i AS sub, v[i * 16 + 1 : i * 16 + 16] AS x FROM b, (SELECT unnest([0, 1, 2, 3]) AS i)),
        book AS (SELECT sub, vec_id AS code, x AS c FROM sub WHERE vec_id < 16),
        near AS (SELECT s.vec_id, s.label, s.sub, k.code, k.c, row_number() OVER (PARTITION BY s.vec_id, s.sub ORDER BY list_distance(s.x, k.c), k.code) AS r FROM sub s JOIN book k USING (sub)),
        enc AS (SELECT vec_id, label, sub, code, c FROM near WHERE r = 1)"""


def _sql_pq(metric: Metric, where: str = "true") -> str:
    d = "power(list_distance(q.x, e.c), 2)" if metric is L2 else "-list_inner_product(q.x, e.c)"
    s = "sqrt(greatest(d, 0))" if metric is L2 else "-d"
    return f"""WITH {_PQ}, s AS (SELECT q.vec_id AS query_id, e.vec_id, sum({d}) AS d FROM sub q JOIN enc e USING (sub) WHERE q.vec_id % {EVERY} = 0 AND {where} GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) SELECT query_id, rank, round({s}, 5) AS score FROM r WHERE rank <= 10"""


def _sql_recall(expr: str) -> str:
    return f"""WITH t AS ({_sql_batch(IP)}), f AS ({_sql_batch(IP, where="b.vec_id % 2 = 0")}),
        h AS (SELECT t.query_id, count(f.vec_id) AS hits, count(*) AS n FROM t LEFT JOIN f USING (query_id, vec_id) GROUP BY t.query_id) SELECT {expr} FROM h"""


ORACLE = {
    "exact_ip_top10": _sql_one(IP), "exact_l2_top10": _sql_one(L2), "exact_batch_ip": _sql_batch(IP), "exact_batch_l2": _sql_batch(L2),
    "exact_batch_scaled_ip": _sql_batch(IP, _SCALED), "exact_batch_scaled_l2": _sql_batch(L2, _SCALED), "exact_columns_l2": _sql_batch(L2, _SCALED),
    "exact_filtered_label": _sql_one(L2, "b.label = 3"), "exact_filtered_batch": _sql_batch(IP, where="b.vec_id % 5 = 0"),
    "exact_filtered_empty_padded": f"SELECT vec_id AS query_id, rank, -1 AS vec_id, {FLOAT32_MAX!r}::DOUBLE AS score FROM embeddings, (SELECT unnest([1, 2, 3]) AS rank) WHERE vec_id % {EVERY} = 0",
    "exact_pad_k_gt_n": f"""{_sql_batch(IP, k=8, where="b.vec_id < 6")} UNION ALL SELECT vec_id, rank, -1, {-FLOAT32_MAX!r}::DOUBLE FROM embeddings, (SELECT unnest([7, 8]) AS rank) WHERE vec_id % {EVERY} = 0""",
    "exact_k_zero": _sql_batch(IP, k=0),
    "exact_wide": f"SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS ids, count(*) AS n FROM ({_sql_batch(IP, k=5)}) GROUP BY query_id",
    "exact_within_radius": f"SELECT * FROM ({_sql_batch(L2, k=1_000_000_000)}) WHERE score <= 1.1",
    "incremental_add": _sql_batch(L2),
    "incremental_append": "SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS vec_id FROM embeddings",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "vector_normalize": f"""WITH b AS ({_SCALED}), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS l FROM b)
        SELECT vec_id, i AS i, round(v[i + 1] / l, 5) AS x FROM n, (SELECT unnest(range(64)) AS i)""",
    "memory_stats": "SELECT count(*) AS size, 64 AS dim, count(*) * 256 AS memory_bytes, 'InnerProduct' AS metric FROM embeddings",
    "vectors_search": f"WITH {_VALID.format(where='true')} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM f",
    "vectors_search_masked": f"WITH {_VALID.format(where='vec_id IN (SELECT vec_id FROM vec_mask WHERE keep)')} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM f",
    "vectors_validity": """SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'size' WHEN len(list_filter(embedding, lambda x: x IS NULL)) > 0 THEN 'null element'
        WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'all zero' ELSE 'valid' END AS state, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) AS r FROM vectors) WHERE r = 1 GROUP BY 1""",
    "stored_hits_recall": f"""WITH {_VALID.format(where='true')}, h AS (SELECT DISTINCT query_id, vec_id FROM search_hits WHERE vec_id >= 0),
        p AS (SELECT f.query_id, count(h.vec_id) / count(*) AS r FROM f LEFT JOIN h USING (query_id, vec_id) GROUP BY f.query_id)
        SELECT round(avg(coalesce(r, 0)), 4) AS recall, count(*) AS queries FROM (SELECT DISTINCT query_id FROM q) LEFT JOIN p USING (query_id)""",
    "corpus_counts": """WITH d AS (SELECT bundle, count(*) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS r FROM doc_meta) WHERE r = 1 GROUP BY bundle),
        v AS (SELECT bundle, count(*) AS vectors FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) AS r FROM vectors) WHERE r = 1 GROUP BY bundle)
        SELECT m.bundle, m."count", coalesce(docs, 0) AS docs, coalesce(vectors, 0) AS vectors, coalesce(m."count" = coalesce(docs, 0), false) AS holds, coalesce(metric IN ('L2', 'InnerProduct'), false) AS known_metric
        FROM corpus_manifest m LEFT JOIN d USING (bundle) LEFT JOIN v USING (bundle)""",
    "recall_harness": _sql_recall("round(avg(hits / n), 6) AS recall, count(*) AS queries"), "recall_tests": _sql_recall("round(sum(hits) / (count(*) * 10.0)::DOUBLE, 6) AS recall, count(*) AS queries"),
    "latency_percentiles": "SELECT round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99, round(avg(value::DOUBLE), 6) AS mean FROM events",
    "even_sampling": """SELECT vec_id, i, CASE WHEN label * 5 + 1 <= 7 THEN i ELSE i * (label * 5) // 6 END AS x FROM embeddings, (SELECT unnest(range(7)) AS i) WHERE i < least(7, label * 5 + 1)""",
    "pq_encode": f"WITH {_PQ} SELECT vec_id, sub, code FROM enc",
    "pq_search_l2": _sql_pq(L2), "pq_search_ip": _sql_pq(IP), "pq_search_filtered": _sql_pq(L2, "e.label = 2"),
    "text_normalize": f"SELECT id, coalesce(length(t), -1) AS n, md5(t) AS digest FROM (SELECT id, {_NORMAL} AS t FROM ({_DOCS}))",
    "text_min_length": f"SELECT id FROM ({_DOCS}) WHERE length({_NORMAL}) >= 200",
    "text_snippet": _sql_snippet(_NORMAL, 120, False, "id", _DOCS), "text_snippet_cut": _sql_snippet("substr(text, 1, 300)", 300, True, "id", _DOCS),
    "text_embed": f"SELECT id, md5(title || '. ' || text) AS digest, coalesce(url, '') AS url FROM ({_DOCS})",
    "corpus_documents": f"""WITH n AS (SELECT id AS o, title, url, {_NORMAL} AS t FROM ({_DOCS})), k AS (SELECT row_number() OVER (ORDER BY o) - 1 AS id, title, coalesce(url, '') AS url, t FROM n WHERE length(t) >= 200)
        SELECT id, title, md5(snippet) AS digest, url FROM ({_sql_snippet("t", 500, False, "id, title, url", "SELECT * FROM k")})""",
    "semantic_lookup": f"""WITH {_VALID.format(where='true')}, d AS ({_DOCS}), x AS ({_sql_snippet("text", 80, False, "id, title", "SELECT * FROM d")})
        SELECT query_id, rank, id, title, snippet FROM f JOIN x ON x.id = f.vec_id""",
    "score_radius": f"""WITH b AS ({_E}), s AS (SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.v, b.v) AS d FROM b AS q, b WHERE q.vec_id % {EVERY} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 10)
        SELECT query_id, rank, round(1 - (d - min(d) OVER (PARTITION BY query_id)) / (max(d) OVER (PARTITION BY query_id) - min(d) OVER (PARTITION BY query_id)), 5) AS radius FROM t""",
}

_UNIT = f"""WITH {_VALID.split("q AS (SELECT query_id")[0].rstrip().rstrip(",").format(where="true")}, b AS (SELECT vec_id, e AS v FROM v)"""


def _sql_unit(metric: Metric = IP, k: int = 10, where: str = "true", scale: str = "1") -> str:
    """True neighbours among the valid current vectors at unit length."""
    d, s = ("list_distance(q.v, c.v)", "d") if metric is L2 else ("-list_inner_product(q.v, c.v)", "-d")
    return f"""{_UNIT}, c AS (SELECT vec_id, list_transform(v, lambda x: (x * ({scale}))::FLOAT)::DOUBLE[] AS v FROM b),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, {d} AS d FROM c AS q, c WHERE q.vec_id % {EVERY} = 0 AND ({where})),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, round({s}, 4) AS score FROM r WHERE rank <= {k}"""


_WORD = "18446744073709551616::UHUGEINT"


def _sql_splitmix(seed: int, numbers: str) -> str:
    """(i, z): outputs of the generator for the numbers i of a table."""
    times = lambda z, by: f"(({z})::UHUGEINT * {by}::UHUGEINT % {_WORD})::UBIGINT"
    return f"""SELECT i, xor(z, z >> 31) AS z FROM (SELECT i, {times("xor(z, z >> 27)", 0x94D049BB133111EB)} AS z FROM (SELECT i, {times("xor(z, z >> 30)", 0xBF58476D1CE4E5B9)} AS z
        FROM (SELECT i, (({seed}::UHUGEINT + (i + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {_WORD})::UBIGINT AS z FROM ({numbers}))))"""


def _sql_levels(m: int, numbers: str) -> str:
    return f"SELECT i, floor(-ln(greatest((z >> 11)::DOUBLE / 9007199254740992.0::DOUBLE, 1e-300)) * (1 / ln({m}))::DOUBLE)::INT AS level FROM ({_sql_splitmix(HnswParams().seed, numbers)})"


_PLACES = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings"
_NODES = f"SELECT vec_id, level FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) JOIN ({_sql_levels(8, _PLACES)}) USING (i)"
_LETTERS = f"""d AS (SELECT id, title, text, coalesce(url, '') AS url, title || '. ' || text AS t FROM ({_DOCS}) WHERE title IS NOT NULL AND text IS NOT NULL),
        n AS (SELECT id, list_transform(range(26), lambda i: (length(t) - length(replace(t, chr((97 + i)::INT), '')))::DOUBLE) AS n FROM d),
        e AS (SELECT id, list_transform(n, lambda x: CASE WHEN list_inner_product(n, n) > 0 THEN (x / sqrt(list_inner_product(n, n)))::FLOAT ELSE 0 END)::DOUBLE[] AS e FROM n)"""


def _sql_letters(k: int) -> str:
    return f"""{_LETTERS}, q AS (SELECT row_number() OVER (ORDER BY id) - 1 AS query_id, e AS q FROM e WHERE id % {EVERY} = 0),
        f AS (SELECT query_id, id, -list_inner_product(q, e) AS key FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, id) AS rank FROM f), h AS (SELECT * FROM r WHERE rank <= {k})"""


def _sql_cells(table: str = "embeddings") -> str:
    return f"SELECT vec_id, i, round(e[i + 1]::DOUBLE, 6) AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding AS e FROM {table}), (SELECT unnest(range(64)) AS i)"


def _sql_taken(where: str, limit: str) -> str:
    return f"""WITH n AS (SELECT id AS o, title, url, {_NORMAL} AS t FROM ({_DOCS})), k AS (SELECT row_number() OVER (ORDER BY o) - 1 AS id, title, coalesce(url, '') AS url, t FROM n WHERE {where})
        SELECT id, title, md5(snippet) AS digest FROM ({_sql_snippet("t", 500, False, "id, title, url", f"SELECT * FROM k WHERE id < {limit}")})"""


ORACLE |= {
    "heldout_split": "SELECT count(*) - 40 AS base, 40 AS queries, count(*) AS ids, count(*) - 40 AS dense, count(*) - 41 AS top FROM embeddings",
    "heldout_order": "SELECT place, place AS vec_id FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) WHERE place < (SELECT count(*) - 40 FROM embeddings)",
    "builder_sample": "SELECT least(100, count(*)) AS rows, least(100, count(*)) AS ids FROM embeddings",
    "ground_truth": f"SELECT query_id, rank, vec_id FROM ({_sql_batch(L2)})",
    "ground_truth_of_cut_base": f"""SELECT query_id, rank, vec_id, false AS cut FROM ({_sql_batch(IP)}) UNION ALL SELECT query_id, rank, vec_id, true FROM ({_sql_batch(IP, where="b.label < 5")})""",
    "plan_agreement": f"SELECT query_id, count(*) AS alike, 1.0::DOUBLE AS share FROM ({_sql_batch(L2)}) GROUP BY query_id",
    "nan_last": """SELECT vec_id, row_number() OVER (ORDER BY x, vec_id) AS place FROM (SELECT vec_id, embedding[1] AS x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC) AS r FROM vectors) WHERE r = 1) WHERE x IS NOT NULL""",
    "bench_cells": """SELECT o_orderkey, CASE WHEN v < 100 THEN printf('%.4f', v) ELSE format('{:,.0f}', v) END AS cell, format('{:,}', o_orderkey) AS key FROM (SELECT o_orderkey, o_totalprice::DOUBLE / 1024 AS v FROM orders)""",
    "pq_trained": _sql_unit(), "pq_trained_on_sample": _sql_unit(L2), "pq_trained_masked": _sql_unit(where="c.vec_id % 3 = 0"),
    "pq_figures": """SELECT m, nbits, (64 / m)::INT AS sub_dim, false AS trained_before, true AS trained_after, n AS size, n * m + 256 * power(2, nbits)::BIGINT AS memory_bytes, n * 256 AS raw_bytes,
        round(n * 256 / (n * m + 256 * power(2, nbits)), 4) AS ratio, 0 AS size_after_retraining, 0.0::DOUBLE AS ratio_after FROM (SELECT count(*) AS n FROM embeddings), (VALUES (4, 4), (8, 6), (16, 8)) AS p(m, nbits)""",
    "hnsw_search": _sql_unit(), "hnsw_search_l2": _sql_unit(L2, scale="1 + vec_id % 3"), "hnsw_search_filtered": _sql_unit(where="c.vec_id % 5 = 0"), "hnsw_grown": _sql_unit(), "hnsw_sharded": _sql_unit(k=3),
    "hnsw_search_predicate": f"""WITH t AS ({_sql_unit(where="c.vec_id % 200 = 7")}), p AS (SELECT v.vec_id AS query_id, k.rank FROM (SELECT DISTINCT vec_id FROM ({_UNIT} SELECT vec_id FROM b) WHERE vec_id % {EVERY} = 0) v, (SELECT unnest(range(1, 11)) AS rank) k)
        SELECT query_id, rank, coalesce(t.vec_id, -1) AS vec_id, coalesce(t.score, {-FLOAT32_MAX!r}::DOUBLE) AS score FROM p LEFT JOIN t USING (query_id, rank)""",
    "hnsw_nodes": f"SELECT vec_id, level, level + 1 AS layers, 0 AS self_links, 0 AS over_cap, 0 AS above FROM ({_NODES})",
    "hnsw_entry": f"SELECT arg_min(vec_id, (-level, vec_id)) AS entry_point, max(level) AS max_level, count(*) AS size FROM ({_NODES})",
    "hnsw_invariants": "SELECT unnest(['no self-loops', 'layers within the node''s level', 'links within the target''s level', 'links within the cap', 'entry on the top level']) AS rule, 0 AS n",
    "hnsw_memory": f"SELECT count(*) AS size, (sum(256 + 4 * (16 + 8 * level)))::BIGINT AS memory_bytes, 16 AS m_max0, 1 AS least_ef, 77 AS ef FROM ({_NODES})",
    "hnsw_trace": f"SELECT q.vec_id AS query_id, l.layer, CASE WHEN l.layer = 0 THEN 10 ELSE 1 END AS steps, CASE WHEN l.layer = 0 THEN 10 ELSE 1 END AS places FROM embeddings q, (SELECT unnest(range((SELECT max(level) + 1 FROM ({_NODES})))) AS layer) l WHERE q.vec_id % {EVERY} = 0",
    "hnsw_trace_whole": f"SELECT query_id, rank, vec_id, score, 0 AS not_traced, 0 AS twice FROM ({_sql_batch(L2, k=5)})",
    "corpus_limit": _sql_taken("length(t) >= 400", "30"),
    "embed_texts": f"WITH {_LETTERS} SELECT id AS vec_id, i, round(e[i + 1], 5) AS x FROM e, (SELECT unnest(range(26)) AS i)",
    "embed_on_the_driver": f"""WITH {_LETTERS}, x AS (SELECT id, round(list_inner_product(e, list_transform(range(26), lambda i: i::DOUBLE)), 3) AS x FROM e WHERE id % {EVERY} = 0) SELECT id, x AS chunked, x AS single, ceil(count(*) OVER () / 7)::BIGINT AS calls FROM x""",
    "semantic_queries": f"""WITH {_sql_letters(5)}, s AS ({" UNION ALL ".join(f"SELECT {str(not cut).lower()} AS clean, id, snippet FROM ({_sql_snippet('text', 60, cut, 'id', 'SELECT id, text FROM d')})" for cut in (False, True))})
        SELECT clean, query_id, rank, round(-key, 4) AS score, id, title, snippet, url FROM h JOIN d USING (id) JOIN s USING (id)""",
    "semantic_traced": f"""WITH {_sql_letters(5)}, l AS ({_sql_levels(8, "SELECT i FROM (SELECT row_number() OVER () - 1 AS i FROM d)")})
        SELECT rank, id, (SELECT max(level) FROM l) AS upper, 5 AS bottom, true AS titled FROM h WHERE query_id = (SELECT max(query_id) FROM h)""",
    "semantic_info": f"""WITH {_LETTERS} SELECT count(*) AS "count", 26 AS dim, 'letters' AS model, 'InnerProduct' AS metric, kind AS index_kind, CASE kind WHEN 'exact' THEN 2 ELSE 1 END AS n, (SELECT count(*) FROM region) AS warmed, round(count(*) * 104 / 1e6, 1) AS memory_mb FROM d, (SELECT unnest(['exact', 'hnsw']) AS kind) GROUP BY kind""",
    "corpus_saved": f"""WITH {_LETTERS} SELECT id, title, md5(text) AS digest, url, length(text) AS n, round(e[5], 5) AS e, count(*) OVER () AS "count", 'letters' AS model, 'InnerProduct' AS metric FROM d JOIN e USING (id)""",
    "file_npy": _sql_cells(), "file_fvecs": _sql_cells(),
    "file_sift": f"""WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS query_id FROM embeddings WHERE vec_id % {EVERY} = 0) SELECT p.query_id, rank, t.vec_id FROM ({_sql_batch(L2)}) t JOIN p ON p.vec_id = t.query_id""",
    "index_saved_exact": f"SELECT *, 'L2' AS metric FROM ({_sql_batch(L2)})", "index_saved_pq": _sql_pq(L2), "index_saved_hnsw": _sql_unit(),
    "array_source": f"""WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {EVERY} = 0),
        r AS (SELECT q.vec_id AS query_id, b.i AS vec_id, list_distance(q.v, b.v) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.i) AS rank FROM a q, a b)
        SELECT query_id, rank, vec_id, round(d, 5) AS score FROM r WHERE rank <= 3""",
    "generated_uniform": f"SELECT i // 16 AS vec_id, i % 16 AS i, round(((z >> 40)::DOUBLE / 16777216 * 2 - 1)::FLOAT::DOUBLE, 6) AS x FROM ({_sql_splitmix(9, 'SELECT i FROM range(4800) t(i)')})",
    "generated_gaussian": f"""WITH u AS (SELECT i // 16 AS v, i % 16 AS p, (z >> 11)::DOUBLE / 9007199254740992 AS u FROM ({_sql_splitmix(9, 'SELECT i FROM range(4800) t(i)')})),
        g AS (SELECT a.v, a.p, sqrt(-2 * ln(1 - a.u)) AS r, 2 * pi() * b.u AS w FROM u a JOIN u b ON a.v = b.v AND b.p = a.p + 8 WHERE a.p < 8), x AS (SELECT v, p AS i, r * cos(w) AS x FROM g UNION ALL SELECT v, p + 8, r * sin(w) FROM g)
        SELECT v AS vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY v)), 4) AS x FROM x""",
    "graph_levels": " UNION ALL ".join(f"SELECT {m} AS m, {2 * m} AS m_max0, i AS node, level FROM ({_sql_levels(m, 'SELECT i FROM range(5000) t(i)')})" for m in (2, 8, 16)),
    "job_corpus": f"""WITH n AS (SELECT doc_id AS o, title, {_NORMAL} AS t FROM documents), k AS (SELECT row_number() OVER (ORDER BY o) - 1 AS id, title, t FROM n WHERE length(t) >= 300)
        SELECT id, title, md5(snippet) AS digest, '' AS url, 16 AS dim, 1.0::DOUBLE AS norm, count(*) OVER () AS "count" FROM ({_sql_snippet("t", 90, False, "id, title", "SELECT * FROM k")})""",
    "job_indexes": f"SELECT kind, n AS size FROM (SELECT count(*) AS n FROM documents WHERE length({_NORMAL}) >= 300), (SELECT unnest(['exact', 'pq', 'hnsw']) AS kind)",
    "job_bench": """SELECT name, 580 AS n, 16 AS dim, 10 AS k, CASE name WHEN 'exact' THEN 580 * 64.0::DOUBLE WHEN 'pq(m=4)' THEN 580 * 4.0::DOUBLE + 16384 END AS memory, CASE WHEN name IN ('exact', 'hnsw(ef=600)') THEN 1.0::DOUBLE END AS recall,
        true AS timed, true AS known_host FROM (SELECT unnest(['exact', 'hnsw(ef=16)', 'hnsw(ef=600)', 'pq(m=4)']) AS name)""",
}
