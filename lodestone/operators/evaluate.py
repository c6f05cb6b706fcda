"""Ground truth, recall, latency and throughput."""

from __future__ import annotations

import copy
import json
import os
import platform
import subprocess
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import Metric
from . import storage
from .exact import ExactIndex

# The benchmark's repetition counts and seed.
LATENCY_SAMPLES, THROUGHPUT_PASSES, WARM_UP, SAMPLE_SEED = 10_000, 7, 64, 20240917
EF_SWEEP = (16, 32, 64, 128)


def ground_truth(index: ExactIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    return index.search(queries, k)


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the mean over queries of hits / size of the truth.

    Padding (vec_id < 0) and repeated rows don't count. A query without truth adds 0
    but stays in the denominator; without queries the mean is 0.
    """
    f = found.where("vec_id >= 0").select("query_id", "vec_id").distinct()
    t = truth.where("vec_id >= 0").select("query_id", "vec_id").distinct()
    hits = t.join(f.withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count("*")).alias("r"))
    q = queries.select("query_id").distinct().join(hits, "query_id", "left")
    return q.agg(F.coalesce(F.avg(F.coalesce("r", F.lit(0.0))), F.lit(0.0)).alias("recall"), F.count("*").alias("queries"))


def recall_at(found: DataFrame, truth: DataFrame, nq: int, k: int) -> DataFrame:
    """One row: hits / (nq * k), however many the truth holds."""
    f = found.where("vec_id >= 0").select("query_id", "vec_id").distinct()
    t = truth.where("vec_id >= 0").select("query_id", "vec_id").distinct()
    return f.join(t, ["query_id", "vec_id"]).agg((F.count("*") / F.lit(float(max(nq * k, 1)))).alias("recall"))


def agreement(a: DataFrame, b: DataFrame, nq: int, k: int) -> DataFrame:
    """The share of places that two plans fill alike."""
    return recall_at(a, b, nq, k)


def held_out(vectors: DataFrame, nq: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(base, queries): min(nq, n - 1) rows by hash order become queries and leave the base.

    The base gets dense ids again, in the order of the old ones, kept as ``old_id``.
    """
    from ..session import stage
    from ..sources.corpus import dense_ids

    n = vectors.count()
    take = max(0, min(nq, n - 1))
    q = stage(vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(take).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "held")
    base = vectors.join(q.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti").withColumnRenamed("vec_id", "old_id")
    return dense_ids(base, "old_id", "vec_id"), q


def builder_sample(vectors: DataFrame, rows: int = 100_000, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows without replacement, in id order: what an index builder trains on."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(rows).orderBy("vec_id")


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """One row p50, p99, mean (linear interpolation), as latencies are reported."""
    v = F.col(value).cast("double")
    return df.agg(F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.99)).alias("p99"), F.avg(v).alias("mean"))


def timed(spark: SparkSession, run: Callable[[object], object], arguments: Iterable[object]) -> DataFrame:
    """(call, ms): wall-clock milliseconds of ``run`` on each argument."""
    marks = [time.perf_counter()]
    for a in arguments:
        run(a)
        marks.append(time.perf_counter())
    return spark.createDataFrame([(i, float(ms)) for i, ms in enumerate(np.diff(marks) * 1000)], "call int, ms double")


def latency(spark: SparkSession, search: Callable[[np.ndarray], object], queries: np.ndarray, samples: int = LATENCY_SAMPLES, seed: int = SAMPLE_SEED) -> DataFrame:
    """One row p50, p99, mean: milliseconds of single calls on queries drawn with replacement; null without any."""
    drawn = np.random.default_rng(seed).choice(len(queries), samples) if len(queries) else ()
    return percentiles(timed(spark, search, (queries[i] for i in drawn)), "ms")


def throughput(spark: SparkSession, run: Callable[[], object], nq: int, passes: int = THROUGHPUT_PASSES, warm_up: Callable[[], object] | None = None) -> float:
    """Queries a second by the median time of the passes over the whole batch."""
    if warm_up:
        warm_up()
    ms = percentiles(timed(spark, lambda _: run(), range(max(1, passes))), "ms").first()["p50"]
    return 1000 * nq / max(ms, 1e-6)


def truth_of(base: DataFrame, queries: DataFrame, metric: Metric, dim: int, k: int, shipped: DataFrame | None = None, cut: bool = False) -> DataFrame:
    """(query_id, rank, vec_id): the shipped neighbours, or new ones where none are shipped or
    the base was cut, which takes true neighbours away."""
    if shipped is None or cut:
        return ground_truth(ExactIndex(dim, metric, base), queries, k).select("query_id", "rank", "vec_id")
    return shipped.join(queries.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= k)


@dataclass
class BenchResult:
    name: str
    dataset: str
    n: int
    dim: int
    k: int
    recall: float
    p50_ms: float | None
    p99_ms: float | None
    mean_ms: float | None
    qps_1t: float | None
    qps_mt: float | None
    memory_mb: float | None
    build_s: float | None


def one_task(index):
    """The same index with its table in one partition: what a single thread searches."""
    one = copy.copy(index)
    for name in ("vectors", "codes", "graph"):
        if getattr(one, name, None) is not None:
            setattr(one, name, getattr(one, name).coalesce(1))
    return one


def benchmark(name: str, dataset: str, index, queries: DataFrame, truth: DataFrame, k: int = 10, build_s: float | None = None, passes: int = THROUGHPUT_PASSES, samples: int = LATENCY_SAMPLES) -> BenchResult:
    """Recall, latency of single calls and throughput of batches of an index that has ``search(queries, k)``.

    A single call is a Spark job, so its latency holds the scheduling of one.
    """
    from ..session import stage

    spark, nq = queries.sparkSession, queries.count()
    found = stage(index.search(queries, k), "bench")
    r = recall(found, truth, queries).first()["recall"]
    few = queries.limit(WARM_UP)
    drain = lambda i, q=queries: i.search(q, k).write.format("noop").mode("overwrite").save()
    drain(index, few)
    picks = np.array([x[0] for x in few.select("query").collect()], np.float32)  # WARM_UP rows
    call = lambda v: drain(index, spark.createDataFrame([(0, v.tolist())], "query_id long, query array<float>"))
    ms = latency(spark, call, picks, samples).first()
    single = throughput(spark, lambda: drain(one_task(index)), nq, passes)
    qps = throughput(spark, lambda: drain(index), nq, passes)
    return BenchResult(name, dataset, index.size, index.dim, k, r, ms["p50"], ms["p99"], ms["mean"], single, qps, index.memory_bytes / 1e6, build_s)


def provenance(spark: SparkSession) -> dict:
    """Where and with what a result was made."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, cwd=os.path.dirname(__file__)).stdout.strip()
    return {
        "host": platform.node(), "platform": platform.platform(), "python": platform.python_version(), "numpy": np.__version__, "spark": pyspark.__version__, "cpus": os.cpu_count(),
        "master": spark.sparkContext.master, "commit": git("rev-parse", "HEAD") or None, "dirty": bool(git("status", "--porcelain")), "time_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
    }


def write_report(path: str, spark: SparkSession, results: list[BenchResult]) -> None:
    """One JSON file, on any file system of the session."""
    storage.write_json(spark, path, json.dumps({"schema_version": 1, "provenance": provenance(spark), "results": [asdict(r) for r in results]}, indent=2))


# The headings of the table and the figures under them.
HEADINGS = {"index": "name", "N": "n", "dim": "dim", "k": "k", "recall@k": "recall", "p50(ms)": "p50_ms", "p99(ms)": "p99_ms", "QPS(1t)": "qps_1t", "QPS(mt)": "qps_mt", "mem(MB)": "memory_mb"}


def shown(v: object) -> str:
    """Integers and floats of 100 and more with thousands separators, other floats with four decimals, '-' for none."""
    match v:
        case None:
            return "-"
        case float():
            return format(v, ".4f" if v < 100 else ",.0f")
        case int():
            return format(v, ",")
    return str(v)


def text_table(results: list[BenchResult]) -> str:
    """A right-aligned table: headings, a rule, one line a result."""
    columns = [[h, *(shown(getattr(r, f)) for r in results)] for h, f in HEADINGS.items()]
    for c in columns:
        width = max(map(len, c))
        c.insert(1, "-" * width)
        c[:] = [v.rjust(width) for v in c]
    return "\n".join(map("  ".join, zip(*columns)))
