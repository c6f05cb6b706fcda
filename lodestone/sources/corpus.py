"""Document corpora: loading, dense ids, and the vectors/metadata/manifest bundle."""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import default_url, long_enough, normalize_whitespace, trim_snippet
from ..functions.vectors import to_matrix
from ..operators import storage
from ..types import Metric
from . import files

DOC = "id long, title string, text string, url string"
MANIFEST = "count long, dim int, model string, metric string, snippet_chars int, clean_snippets boolean"


def dense_ids(df: DataFrame, order_by: str, id_col: str = "id", start: int = 0) -> DataFrame:
    """Adds ids start, start + 1, ... in ``order_by`` order.

    Rows are ranked inside range partitions and shifted by the partitions' offsets,
    so no task sorts the whole table. Equal keys are ordered arbitrarily.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from ..session import stage

    x = stage(df.repartitionByRange(n, F.col(order_by)).withColumn("_p", F.spark_partition_id()), "ranked")
    offset = x.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    ranked = x.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order_by)) - 1)
    return ranked.join(F.broadcast(offset.select("_p", "_off")), "_p").withColumn(id_col, (F.col("_r") + F.col("_off") + start).cast("long")).drop("_p", "_r", "_off")


def take_documents(pages: DataFrame, order_by: str, limit: int = 100_000, snippet_chars: int = 500, min_chars: int = 200) -> DataFrame:
    """Pages (title, text, url?) to documents: white space normalized, too short ones
    dropped, the first ``limit`` in ``order_by`` order under dense ids, snippets trimmed."""
    url = default_url(F.col("url")) if "url" in pages.columns else F.lit("")
    x = pages.where(long_enough(F.col("text"), min_chars)).select(F.col(order_by).alias("_o"), "title", normalize_whitespace(F.col("text")).alias("text"), url.alias("url"))
    x = dense_ids(x, "_o").where(F.col("id") < limit)  # ranks come from range partitions, so no task takes them all
    return x.select("id", "title", trim_snippet(F.col("text"), snippet_chars).alias("text"), "url")


# -- the bundle as tables ---------------------------------------------------


def manifest_of(count: int, dim: int, model: str, metric: Metric, snippet_chars: int = 500, clean_snippets: bool = True) -> dict:
    return {"count": count, "dim": dim, "model": model, "metric": Metric.of(metric).value, "snippet_chars": snippet_chars, "clean_snippets": clean_snippets}


def save_corpus(path: str, vectors: DataFrame, docs: DataFrame, manifest: dict) -> None:
    """Writes vectors/ (vec_id, embedding), meta/ (documents) and manifest.json.

    Raises where the ids of the two don't match one to one, or the manifest's count differs.
    """
    spark = docs.sparkSession
    _require_same_ids(vectors, docs)
    n = docs.count()
    if manifest.get("count") != n:
        raise ValueError(f"the manifest counts {manifest.get('count')} documents, there are {n}")
    Metric.of(manifest["metric"])
    vectors.select("vec_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    docs.select("id", "title", "text", "url").write.mode("overwrite").json(f"{path}/meta", ignoreNullFields=False)
    storage.write_json(spark, f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False))


def _require_same_ids(vectors: DataFrame, docs: DataFrame) -> None:
    v, d = vectors.select(F.col("vec_id").alias("id")), docs.select("id")
    r = v.groupBy("id").agg(F.count("*").alias("v")).join(d.groupBy("id").agg(F.count("*").alias("d")), "id", "full").where("coalesce(v, 0) <> 1 or coalesce(d, 0) <> 1").agg(F.count("*")).first()
    if r[0]:
        raise ValueError(f"vectors and documents differ: {r[0]} ids don't occur once in both")


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(storage.read_text(spark, f"{path}/manifest.json"))


def load_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(documents, manifest); raises where the manifest has a count and it differs."""
    manifest = load_manifest(spark, path)
    meta = f"{path}/meta" if storage.exists(spark, f"{path}/meta") else f"{path}/meta.jsonl"
    docs = spark.read.schema(DOC).json(meta)
    if manifest.get("count") is not None and docs.count() != manifest["count"]:
        raise ValueError(f"the manifest counts {manifest['count']} documents, there are {docs.count()}")
    return docs, manifest


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(vectors, documents, manifest) of a bundle, as tables or as vectors.npy and meta.jsonl."""
    docs, manifest = load_metadata(spark, path)
    vectors = spark.read.parquet(f"{path}/vectors") if storage.exists(spark, f"{path}/vectors") else read_npy(spark, f"{path}/vectors.npy")
    _require_same_ids(vectors, docs)
    return vectors, docs, manifest


def pick_corpus(spark: SparkSession, candidates: list[str], variable: str = "LODESTONE_CORPUS") -> str:
    """The corpus named by the environment variable, else the first candidate with a manifest."""
    named = os.environ.get(variable)
    if named:
        if not storage.exists(spark, f"{named}/manifest.json"):
            raise OSError(f"{variable} names {named}, which has no manifest.json")
        return named
    for c in candidates:
        if storage.exists(spark, f"{c}/manifest.json"):
            return c
    raise OSError(f"no corpus among {candidates}")


def _npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """(shape, type, Fortran order, bytes before the data)."""
    head = io.BytesIO(files.read(path, 0, 4096))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    return shape, dtype, fortran, head.tell()


def read_npy(spark: SparkSession, path: str, chunk_rows: int = 50_000) -> DataFrame:
    """(vec_id, embedding) of a two-dimensional float .npy file in row order, ids being row numbers.

    The header is read once; each task reads its own ranges of rows, from any file
    system that all executors see.
    """
    shape, dtype, fortran, start = _npy_header(path)
    if len(shape) != 2 or fortran or dtype.kind != "f":
        raise ValueError(f"{path}: expected two dimensions of floats in row order, not {shape} of {dtype}")
    parts = [(a, min(a + chunk_rows, shape[0])) for a in range(0, shape[0], chunk_rows)]
    width = shape[1] * dtype.itemsize

    def run(batches):
        for d in batches:
            for a, b in zip(d["a"], d["b"]):
                for at in range(a, b, 8192):
                    n = min(at + 8192, b) - at
                    y = np.frombuffer(files.read(path, start + at * width, n * width), dtype).reshape(n, -1).astype(np.float32)
                    yield pd.DataFrame({"vec_id": np.arange(at, at + n), "embedding": list(y)})

    ranges = spark.createDataFrame(parts or [(0, 0)], "a long, b long").repartition(max(1, len(parts)))
    return ranges.mapInPandas(run, "vec_id long, embedding array<float>")


def write_npy(vectors: DataFrame, path: str, dim: int) -> int:
    """Writes embeddings in vec_id order as one float32 .npy file; returns the rows.

    One file has one writer: packed batches are streamed through the driver, one
    partition at a time.
    """
    n = vectors.count()

    def run(batches):
        for d in batches:
            if len(d):
                yield pd.DataFrame({"x": [to_matrix(d["embedding"], dim).tobytes()]})

    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n, dim)})
    f, p = files.resolve(path)
    with f.open_output_stream(p) as out:
        out.write(head.getvalue())
        for r in vectors.select("vec_id", "embedding").orderBy("vec_id").select("embedding").mapInPandas(run, "x binary").toLocalIterator():
            out.write(bytes(r["x"]))
    return n
