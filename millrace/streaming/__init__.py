"""Keyed operators on streams: the row-wise ones of Dataset work on a streaming DataFrame as they are; sums and counts by
key get an event-time window and a watermark, so that state is bounded and late rows are dropped after a set delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import Dataset


def stream_files(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", files_each: int = 100) -> Dataset:
    """A Dataset that follows the files of a folder, so many in each micro-batch."""
    return Dataset(spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_each).load(path))


def sum_by_key_in_windows(
    events: Dataset, time: str, key: str | Sequence[str], value: str, width: str, late: str, slide: str | None = None, agg: Column | None = None, out: str | None = None
) -> Dataset:
    """(window_start, window_end, key, sum) of tumbling or sliding windows. Rows later than `late` are dropped; windows are
    final, and can be appended to a sink, once the watermark has passed them. On a table all windows are final at once."""
    keys = [key] if isinstance(key, str) else list(key)
    df = events.df.withWatermark(time, late) if events.df.isStreaming else events.df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    total = (agg if agg is not None else F.sum(value)).alias(out or value)
    g = df.groupBy(w.alias("w"), *keys).agg(total)
    return Dataset(g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, out or value))


def drain(d: Dataset, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Processes what is there and stops; a second call goes on where the first ended, each row once."""
    q = d.df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
