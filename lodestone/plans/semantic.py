"""Text queries to ranked documents."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import Embedder, embedder_for
from ..functions.text import radius_norm, trim_snippet
from ..operators import storage
from ..operators.exact import ExactIndex
from ..operators.hnsw import HnswIndex
from ..sources.corpus import load_corpus, load_metadata
from ..types import Metric

#: Results that are broadcast to the documents in a lookup: at most this many rows,
#: beyond which the join is shuffled.
BROADCAST_RESULTS = 100_000


def lookup(results: DataFrame, docs: DataFrame, snippet_chars: int = 500, already_cut: bool = False, rows: int | None = None) -> DataFrame:
    """(query_id, rank, score, id, title, text, url): results with their documents.

    Padded places (vec_id < 0) and ids without a document are left out; ranks are
    the places in the result list. ``rows``: an upper bound of the results, if known.
    """
    hits = results.where("vec_id >= 0").select("query_id", "rank", "score", F.col("vec_id").alias("id"))
    if rows is not None and rows <= BROADCAST_RESULTS:
        hits = F.broadcast(hits)
    x = docs.select("id", "title", "text", "url").join(hits, "id")
    return x.select("query_id", "rank", "score", "id", "title", trim_snippet(F.col("text"), snippet_chars, already_cut).alias("text"), "url")


class SemanticSearch:
    def __init__(self, index: ExactIndex | HnswIndex, docs: DataFrame, embedder: Embedder, manifest: dict):
        if embedder.dim != index.dim:
            raise ValueError(f"the embedder makes {embedder.dim} dimensions, the index has {index.dim}")
        self.index, self.docs, self.embedder, self.manifest = index, docs, embedder, manifest

    @classmethod
    def from_corpus(cls, spark: SparkSession, path: str, embedder: Embedder | None = None, prefer_hnsw: bool = True) -> SemanticSearch:
        """Serves the corpus's stored graph if there is one, else searches its vectors exactly.

        With a graph the vectors are not read. The metric is the inner product where the
        manifest names none, the dimension that of the vectors, the embedder the one of
        the manifest's model.
        """
        if prefer_hnsw and storage.exists(spark, f"{path}/hnsw/index.json"):
            docs, manifest = load_metadata(spark, path)
            index = HnswIndex.load(spark, f"{path}/hnsw")
            if index.size != docs.count():
                raise ValueError(f"the index holds {index.size} vectors, there are {docs.count()} documents")
        else:
            vectors, docs, manifest = load_corpus(spark, path)
            one = vectors.first()
            dim = manifest.get("dim") or 1 if one is None else len(one["embedding"])
            index = ExactIndex(dim, Metric.of(manifest.get("metric") or Metric.INNER_PRODUCT), vectors)
        return cls(index, docs, embedder or embedder_for(manifest.get("model")), manifest)

    @property
    def already_cut(self) -> bool:
        """Snippets were cut without regard to words when the corpus was made."""
        return not self.manifest.get("clean_snippets", False)

    def _embedded(self, texts: list[str]) -> DataFrame:
        spark = self.docs.sparkSession
        rows = [(i, [float(v) for v in e]) for i, e in enumerate(self.embedder.encode(texts))]
        return spark.createDataFrame(rows, "query_id long, query array<float>")

    def _found(self, results: DataFrame, rows: int) -> DataFrame:
        return lookup(results, self.docs, self.manifest.get("snippet_chars") or 500, self.already_cut, rows)

    def query_many(self, texts: list[str], k: int = 10) -> DataFrame:
        """Results of many texts at once; query_id is the place in the list."""
        return self._found(self.index.search(self._embedded(texts), k), len(texts) * k)

    def query(self, text: str, k: int = 10) -> tuple[list, float]:
        """(rows by rank, milliseconds of the search without the embedding)."""
        q = self._embedded([text])
        began = time.perf_counter()
        rows = self._found(self.index.search(q, k), k).orderBy("rank").collect()  # k rows
        return rows, (time.perf_counter() - began) * 1000

    def query_traced(self, text: str, k: int = 10, max_trace: int = 40) -> tuple[list, list, int, float]:
        """(rows, trace with titles, visited, milliseconds); without a graph the trace is empty."""
        if not isinstance(self.index, HnswIndex):
            rows, ms = self.query(text, k)
            return rows, [], 0, ms
        q = self._embedded([text])
        began = time.perf_counter()
        found, trace, visited = self.index.search_traced(q, k, max_trace)
        rows = self._found(found, k).orderBy("rank").collect()
        ms = (time.perf_counter() - began) * 1000
        steps = trace.join(self.docs.select(F.col("id").alias("vec_id"), "title"), "vec_id").orderBy("shard", "step").select("layer", "title", "score").collect()
        total = visited.first()
        return rows, steps, total["total_visited"] if total else 0, ms

    def info(self) -> DataFrame:
        """One row: count, dim, model, metric, index kind, memory in MB."""
        kind = "hnsw" if isinstance(self.index, HnswIndex) else "exact"
        one = self.docs.sparkSession.createDataFrame([(self.docs.count(), self.index.dim, self.manifest.get("model"), self.index.metric.value, kind, self.index.memory_bytes)], "count long, dim int, model string, metric string, index_kind string, memory_bytes long")
        return one.select("count", "dim", "model", "metric", "index_kind", F.round(F.col("memory_bytes") / 1e6, 1).alias("memory_mb"))

    def warm_up(self, texts: tuple[str, ...] = ("history of science", "music", "mountains", "computers"), times: int = 1) -> int:
        """Runs some searches so that files are cached and code compiled; failures are ignored."""
        done = 0
        for _ in range(times):
            for t in texts:
                try:
                    self.query(t, 10)
                    done += 1
                except Exception:
                    continue
        return done


def display_radius(results: DataFrame, metric: Metric) -> DataFrame:
    """Adds ``radius``: each query's scores, min-max normed for display, near results inside."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id")
    return results.withColumn("radius", radius_norm(F.col("score"), F.min("score").over(w), F.max("score").over(w), metric is Metric.INNER_PRODUCT))
