"""Jobs: build-corpus, build-index, search, bench. Run with ``python -m lodestone.cli``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.embedding import embedder_for, encode
from .functions.text import embed_text
from .operators import evaluate
from .operators.exact import ExactIndex
from .operators.hnsw import HnswIndex
from .operators.pq import PqIndex
from .plans.semantic import SemanticSearch
from .session import stage
from .sources.corpus import load_corpus, manifest_of, save_corpus, take_documents
from .sources.synthetic import gaussian_unit
from .sources.vecsio import load_sift
from .types import HnswParams, Metric, PqParams


def natural(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("build-corpus", help="pages (title, text, url) to a corpus")
    c.add_argument("pages")
    c.add_argument("out")
    c.add_argument("--order-by", default="id")
    c.add_argument("--limit", type=natural, default=100_000)
    c.add_argument("--snippet-chars", type=natural, default=500)
    c.add_argument("--min-chars", type=natural, default=200)
    c.add_argument("--model", default=None, help="a sentence model, or hashing-D for the stand-in of D dimensions")
    c.add_argument("--dim", type=natural, default=64, help="of the stand-in, without --model")
    i = sub.add_parser("build-index", help="an index of a corpus")
    i.add_argument("corpus")
    i.add_argument("--type", choices=("hnsw", "exact", "pq"), default="hnsw")
    i.add_argument("--m", type=natural, default=16)
    i.add_argument("--ef-construction", type=natural, default=200)
    i.add_argument("--shard-rows", type=natural, default=20_000)
    s = sub.add_parser("search", help="ranked documents for a text, or for each line read")
    s.add_argument("corpus")
    s.add_argument("text", nargs="*")
    s.add_argument("--k", type=natural, default=5)
    s.add_argument("--exact", action="store_true")
    b = sub.add_parser("bench", help="recall, latency and throughput on a corpus, on generated vectors or on a folder of fvecs files")
    b.add_argument("corpus", nargs="?")
    b.add_argument("--synthetic", type=natural, nargs=2, metavar=("N", "DIM"), help="unit vectors of normal values")
    b.add_argument("--sift", metavar="FOLDER", help="base, query and groundtruth files, in L2")
    b.add_argument("--n", type=natural, default=0, help="first vectors of the base only; true neighbours are then sought anew")
    b.add_argument("--queries", "--nq", type=natural, default=1000)
    b.add_argument("--k", type=natural, default=10)
    b.add_argument("--ef", type=efs, default=list(evaluate.EF_SWEEP), help="beams of the graph, separated by commas")
    b.add_argument("--m", type=natural, default=16)
    b.add_argument("--ef-construction", type=natural, default=200)
    b.add_argument("--pq-m", type=natural, default=16, help="bytes of a code; 0 leaves quantized search out")
    b.add_argument("--passes", type=natural, default=evaluate.THROUGHPUT_PASSES)
    b.add_argument("--latency-samples", type=natural, default=100, help="single calls that are timed; each is a Spark job")
    b.add_argument("--out")
    return p


def efs(text: str) -> list[int]:
    return [natural(part) for part in text.split(",") if part.strip()]


def bench_data(spark: SparkSession, a: argparse.Namespace):
    """(name, base, queries, truth, metric, dim) of what the arguments name."""
    shipped, cut = None, False
    if a.sift:
        s = load_sift(spark, a.sift)
        cut = bool(a.n) and a.n < s.base.count()
        base, queries, shipped = s.base.where(F.col("vec_id") < a.n) if cut else s.base, s.queries.where(F.col("query_id") < a.queries), s.ground_truth
        name, metric, dim = s.name, s.metric, len(base.first()["embedding"])
    else:
        if a.synthetic:
            n, dim = a.synthetic
            name, metric, vectors = f"gaussian-{n}x{dim}", Metric.INNER_PRODUCT, gaussian_unit(spark, n, dim)
        elif a.corpus:
            vectors, _, manifest = load_corpus(spark, a.corpus)
            name, metric, dim = a.corpus, Metric.of(manifest["metric"]), manifest["dim"]
        else:
            raise SystemExit("bench needs a corpus, --synthetic or --sift")
        if a.n:
            vectors = vectors.where(F.col("vec_id") < a.n)
        base, queries = evaluate.held_out(vectors, a.queries)
    base, queries = stage(base.select("vec_id", "embedding"), "base"), stage(queries.select("query_id", "query"), "asked")
    return name, base, queries, stage(evaluate.truth_of(base, queries, metric, dim, a.k, shipped, cut), "truth"), metric, dim


def bench(spark: SparkSession, a: argparse.Namespace) -> list[evaluate.BenchResult]:
    name, base, queries, truth, metric, dim = bench_data(spark, a)
    own = {"k": a.k, "passes": a.passes, "samples": a.latency_samples}
    results = [evaluate.benchmark("exact", name, ExactIndex(dim, metric, base), queries, truth, build_s=0.0, **own)]
    began = time.time()
    graph = HnswIndex(dim, metric, HnswParams(a.m, a.ef_construction)).add(base).staged()
    built = time.time() - began
    for ef in a.ef:
        graph.ef_search = ef
        results.append(evaluate.benchmark(f"hnsw(ef={ef})", name, graph, queries, truth, build_s=built, **own))
    if a.pq_m and not dim % a.pq_m and base.count() >= 256:
        began = time.time()
        codes = PqIndex(dim, metric, PqParams(m=a.pq_m)).train(base).add(base)
        codes.codes = stage(codes.codes, "codes")
        results.append(evaluate.benchmark(f"pq(m={a.pq_m})", name, codes, queries, truth, build_s=time.time() - began, **own))
    return results


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lodestone {a.job}").getOrCreate()
    if a.job == "build-corpus":
        docs = take_documents(spark.read.parquet(a.pages), a.order_by, a.limit, a.snippet_chars, a.min_chars)
        model = a.model or f"hashing-{a.dim}"
        embedder = embedder_for(model)
        vectors = encode(docs.select(F.col("id").alias("vec_id"), embed_text(F.coalesce("title", F.lit("")), F.col("text")).alias("t")), "t", embedder).select("vec_id", "embedding")
        save_corpus(a.out, vectors, docs, manifest_of(docs.count(), embedder.dim, model, Metric.INNER_PRODUCT, a.snippet_chars, True))
        return 0
    if a.job == "search":
        found = SemanticSearch.from_corpus(spark, a.corpus, prefer_hnsw=not a.exact)
        for text in [" ".join(a.text)] if a.text else map(str.strip, sys.stdin):
            if text:
                for r in found.query(text, a.k)[0]:
                    print(f"{r['rank']:>3}  {r['score']:.3f}  {r['title']}  {(r['text'] or '')[:110]}")
        return 0
    if a.job == "build-index":
        vectors, docs, manifest = load_corpus(spark, a.corpus)
        metric, dim = Metric.of(manifest["metric"]), manifest["dim"]
        if a.type == "exact":
            ExactIndex(dim, metric, vectors).save(f"{a.corpus}/exact")
        elif a.type == "pq":
            PqIndex(dim, metric, PqParams(m=a.m)).train(evaluate.builder_sample(vectors)).add(vectors).save(f"{a.corpus}/pq")
        else:
            HnswIndex(dim, metric, HnswParams(a.m, a.ef_construction), shard_rows=a.shard_rows).add(vectors).save(f"{a.corpus}/hnsw")
        return 0
    results = bench(spark, a)
    print(evaluate.text_table(results))
    if a.out:
        evaluate.write_report(a.out, spark, results)
    return 0


if __name__ == "__main__":
    sys.exit(main())
