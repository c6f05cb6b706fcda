"""Extension: appending a stream of vectors or documents to tables that indexes read.

The engine itself has no stream semantics; these are the streaming form of ``add``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import is_valid, require_valid


def append_vectors(stream: DataFrame, path: str, checkpoint: str, dim: int, reject_path: str | None = None, once: bool = True) -> StreamingQuery:
    """Appends (vec_id, embedding, ...) rows to the Parquet table at ``path``.

    Invalid vectors fail the batch, or go to ``reject_path`` where one is given. A
    batch that is delivered again replaces its own rows, which are kept under its number.
    """

    def write(df: DataFrame, batch: int) -> None:
        if reject_path:
            ok = is_valid(F.col("embedding"), dim)
            df.where(~ok).write.mode("overwrite").parquet(f"{reject_path}/batch={batch}")
            df = df.where(ok)
        else:
            df = require_valid(df, "embedding", dim)
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current_stream(stream: DataFrame, key: str, ts: str, lateness: str = "7 days") -> DataFrame:
    """Drops rows delivered again (same key and time) within the watermark."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key, ts])
