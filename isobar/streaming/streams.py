"""Streaming forms of what the batch side does step by step.

A stream of observations is summed in windows with a watermark, sessions stand
in for runs of exceedances, and finished months are written once, the checkpoint
being the mark of what is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; files that appear later are read then."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _event_time(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_sums(rows: DataFrame, ts: str, value: str, keys: list[str], hours: int = 6, late: str = "6 hours") -> DataFrame:
    """Sums in windows of ``hours``; rows later than ``late`` don't count."""
    w = F.window(F.col(ts), f"{hours} hours")
    out = _event_time(rows, ts).withWatermark(ts, late).groupBy(w, *keys).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, value, "n")


def sessions(rows: DataFrame, ts: str, value: str, keys: list[str], gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    """Runs of rows of a key with no gap longer than ``gap``."""
    w = F.session_window(F.col(ts), gap)
    out = _event_time(rows, ts).withWatermark(ts, late).groupBy(w, *keys).agg(F.avg(value).alias("mean_intensity"), F.max(value).alias("max_intensity"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), *keys, "mean_intensity", "max_intensity", "n")


def write_once(rows: DataFrame, path: str, checkpoint: str, partition: list[str], every: str | None = None) -> StreamingQuery:
    """Appends each batch under its partitions; restarted, it goes on after the last batch."""
    out = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).partitionBy(*partition).outputMode("append")
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def on_complete(rows: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Runs ``then`` on each new batch, once, in order."""
    out = rows.writeStream.foreachBatch(then).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
