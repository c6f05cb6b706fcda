"""Session helpers: a tuned local session and staging of intermediate tables.

Lineage is cut by writing a Parquet table into the folder that all executors
share (``spark.checkpoint.dir``). Files there outlive lost executors, are
columnar and compressed, and can be read again by any stage.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", app: str = "lodestone", **conf: str) -> SparkSession:
    """A single-machine session for tests and benches."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder
    is made and set.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of the copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(keep: int = 0) -> None:
    """Delete the staged tables of this process but for the first ``keep``; scans of them end
    with it. One that can't be deleted is told by a warning and doesn't keep the others."""
    while len(_staged) > keep:
        spark, path = _staged.pop()
        if spark.sparkContext._jsc is None:
            continue  # the session ended
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception as e:
            warnings.warn(f"could not delete {path}: {e}", stacklevel=2)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at its end, so a long session doesn't fill the shared
    folder; what is to outlive it must be written or collected inside."""
    held = len(_staged)
    try:
        yield
    finally:
        drop_staged(held)


atexit.register(drop_staged)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions to aim for: at least the session's own figure."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
