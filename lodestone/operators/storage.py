"""Small JSON files beside index tables, through the session's file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text; a missing one raises OSError."""
    if not exists(spark, path):
        raise OSError(f"no such file: {path}")
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_index(spark: SparkSession, path: str, kind: str) -> dict:
    meta = json.loads(read_text(spark, f"{path}/index.json"))
    if meta.get("kind") != kind:
        raise ValueError(f"{path} holds a {meta.get('kind')} index, not {kind}")
    return meta
