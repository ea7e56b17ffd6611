"""Streams that end alike however often they were broken off: each micro-batch is one folder, written under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def write_once(stream: DataFrame, path: str, state: str, change: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write what is there of ``stream`` below ``path``, and stop. ``state`` is the folder of the stream's offsets.

    A batch that was written, but not yet noted as done, comes again with the same number and rows and takes its folder's place. So a stream that was
    killed between its batches, or within one, and is then started again ends as one that wasn't.
    """

    def put(batch: DataFrame, number: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with their numbers in ``batch``."""
    return spark.read.parquet(path)
