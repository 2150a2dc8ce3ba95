"""Platform extras, with no counterpart among the array operators: cubes, sketches, JSON, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import edge
from isobar.plans.base import r, read
from isobar.session import new_folder
from isobar.streaming import streams


def x_cube(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), edge(F.avg("l_quantity")).alias("q"))


def x_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderstatus", "o_totalprice")
    return rows.rollup("yr", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), edge(F.avg("o_totalprice")).alias("price"))


def x_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, d, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), edge(F.avg("value")).alias("value"))


def x_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    rich = o.where("o_totalprice > 200000")
    a = c.join(rich, c.c_custkey == rich.o_custkey, "left_semi").withColumn("kind", F.lit("has"))
    b = c.join(rich, c.c_custkey == rich.o_custkey, "left_anti").withColumn("kind", F.lit("none"))
    return a.unionByName(b).groupBy("kind", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def x_approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Approximate against exact distinct counts; within five percent is reported."""
    # Sketches don't change with repeats; next to a distinct count Spark would keep one sketch for each flag and order.
    pairs = read(spark, d, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    out = pairs.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("a"), F.count("l_orderkey").alias("n"))
    return out.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


def _drained(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """A stream over the files that are there, run to its end into a table."""
    path, mark = new_folder(spark, name), new_folder(spark, f"{name}-mark")
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return rows


def x_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour sums by type of a stream; windows that the watermark has closed."""
    out = _drained(spark, streams.tumbling_sums(_events(spark, d), "ts", "value", ["event_type"], 6, "0 hours"), "stream-windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", edge("value").alias("value"), "n")


def x_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions of a stream with gaps of up to six hours, closed ones."""
    out = _drained(spark, streams.sessions(_events(spark, d), "ts", "value", ["user_id"], "6 hours", "0 hours"), "stream-sessions")
    return out.select("user_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"), edge("mean_intensity").alias("mean_intensity"), "n")


QUERIES = {f.__name__: f for f in (x_cube, x_rollup, x_json, x_semi_anti, x_approx_distinct, x_stream_windows, x_stream_sessions)}

ORACLE = {
    "x_cube": f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, {r('avg(l_quantity)')} AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "x_rollup": f"SELECT CAST(yr AS INTEGER) AS yr, o_orderstatus, count(*) AS n, {r('avg(o_totalprice)')} AS price FROM (SELECT year(o_orderdate) AS yr, o_orderstatus, o_totalprice FROM orders) GROUP BY ROLLUP (yr, o_orderstatus)",
    "x_json": f"SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n, {r('avg(value)')} AS value FROM events GROUP BY 1, 2",
    "x_semi_anti": "SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'has' ELSE 'none' END AS kind, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2",
    "x_approx_distinct": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, TRUE AS \"close\" FROM lineitem GROUP BY 1",
    "x_stream_windows": f"""WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, sum(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event_type, {r('value')} AS value, n FROM w WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events)""",
    "x_stream_sessions": f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER u + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOURS AS z, avg(value) AS m, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, a AS start_time, z AS end_time, {r('m')} AS mean_intensity, n FROM x WHERE z <= (SELECT max(ts) FROM events)""",
}
