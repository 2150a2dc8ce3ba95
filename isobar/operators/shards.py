"""Event tables by period and chunk, with states that merge into the summary of a period.

A job owns one chunk of one period: it writes the chunk's events and their state
(counts and sums by bin of each metric) and needs nothing of other chunks.  The
summary of a period adds up states; quantiles read the events of one bin each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators import quantiles
from isobar.sources import sinks

METRICS = ["mean_intensity", "max_intensity", "footprint_area_km2", "duration_hours"]


def write_chunk(events: DataFrame, root: str, period: str, chunk: str, metrics: list[str] = METRICS) -> None:
    """Replaces one chunk: its events and its state."""
    own = events.drop("period", "chunk")
    at = f"period={period}/chunk={chunk}"
    sinks.write_table(own, f"{root}/events/{at}", overwrite=True)
    kept = events.sparkSession.read.schema(own.schema).parquet(f"{root}/events/{at}")
    sinks.write_table(quantiles.state(kept, [], metrics), f"{root}/states/{at}", overwrite=True)


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/events").parquet(f"{root}/events/period=*/chunk=*").withColumn("period", F.col("period").cast("string"))


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """Merged over the chunks of each period."""
    own = spark.read.option("basePath", f"{root}/states").parquet(f"{root}/states/period=*/chunk=*").withColumn("period", F.col("period").cast("string"))
    return quantiles.merge(own, ["period"])


def summary(spark: SparkSession, root: str, metrics: list[str] = METRICS) -> DataFrame:
    """One row a period: n_events and the mean of each metric, from states alone.

    n_events counts events with a finite value of the first metric.  Sums come
    in the order of chunks and bins, so means may differ in the last digits from
    those over all rows.
    """
    found = quantiles.means(read_states(spark, root), ["period"])
    pick = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c)))
    return found.groupBy("period").agg(pick("n", metrics[0]).alias("n_events"), *[pick("mean", m).alias(f"mean_{m.removeprefix('mean_')}") for m in metrics])


def bands(spark: SparkSession, root: str, metrics: list[str], qs: list[float]) -> DataFrame:
    """(period, metric, q, value): exact quantiles over all chunks; events are read for the bins that hold them."""
    return quantiles.exact(read_events(spark, root), ["period"], metrics, qs, read_states(spark, root).where(F.col("metric").isin(metrics)))
