"""Base and delta: an immutable index answers together with rows that streamed in since, until the next rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, fuse


def follow(stream: DataFrame, to: str, checkpoint: str):
    """Append a stream of (doc_id, embedding) to the delta table, exactly once for each batch."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer(base: DataFrame, delta: DataFrame, queries: DataFrame, k: int, tombstones: DataFrame | None = None) -> DataFrame:
    """RRF of the base's ranking and the delta's; rows with a tombstone are left out before scoring."""
    if tombstones is not None:
        base, delta = (x.join(tombstones.select("doc_id"), "doc_id", "left_anti") for x in (base, delta))
    return fuse.rrf([dense.flat_top_k(base, queries, k), dense.flat_top_k(delta, queries, k)])


def windowed(stream: DataFrame, ts: str, late: str, window: str, *by: str) -> DataFrame:
    """Counts by event-time window; a window is given out once the watermark has passed it."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
