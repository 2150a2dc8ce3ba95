"""Driver tables as grids: what the queries and their SQL start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of lineitem as cells: year, month, place (y, x), level p, fields q, u, v and a value.
CELLS_SQL = """SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mo, CAST(l_suppkey % 5 AS INTEGER) AS y, CAST(l_partkey % 4 AS INTEGER) AS x,
  CAST(100 * l_linenumber AS DOUBLE) AS p, l_discount AS q, l_quantity AS u, l_tax AS v, l_extendedprice * (1 - l_discount) AS val FROM lineitem"""
#: Their means by month, place and level.
CUBE_SQL = f"cube AS (SELECT yr, mo, y, x, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(val) AS val FROM ({CELLS_SQL}) GROUP BY yr, mo, y, x, p)"
#: Means by month and place, without levels.
FLAT_SQL = f"flat AS (SELECT yr, mo, y, x, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(val) AS val FROM ({CELLS_SQL}) GROUP BY yr, mo, y, x)"
#: Yearly means by y ("corridor").
YEARLY_SQL = f"yearly AS (SELECT y AS corridor, yr, avg(val) AS ivt, avg(u) AS iwv, avg(q) AS q FROM ({CELLS_SQL}) GROUP BY y, yr)"

REGIONS = [("north", 2.0, 4.0, 0.0, 3.0), ("south", 0.0, 2.0, 1.0, 2.0), ("all", 0.0, 4.0, 0.0, 3.0)]
REGIONS_SQL = "regions(region, lat0, lat1, lon0, lon1) AS (VALUES " + ", ".join(f"('{r}', {', '.join(f'CAST({v} AS DOUBLE)' for v in b)})" for r, *b in REGIONS) + ")"
WINDOWS = [("w1", 1995, 1996), ("w2", 1997, 1998), ("w3", 1999, 2001)]
WINDOWS_SQL = "windows(win, y0, y1) AS (VALUES " + ", ".join(f"('{w}', {a}, {b})" for w, a, b in WINDOWS) + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column expressions over the scan; only what is used is read."""
    return read(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("yr"),
        F.month("l_shipdate").alias("mo"),
        (F.col("l_suppkey") % 5).cast("int").alias("y"),
        (F.col("l_partkey") % 4).cast("int").alias("x"),
        (100 * F.col("l_linenumber")).cast("double").alias("p"),
        F.col("l_discount").alias("q"),
        F.col("l_quantity").alias("u"),
        F.col("l_tax").alias("v"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("val"),
    )


def _means(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("q", "u", "v", "val")])


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(cells(spark, sf_dir), ["yr", "mo", "y", "x", "p"])


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(cells(spark, sf_dir), ["yr", "mo", "y", "x"])


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy(F.col("y").alias("corridor"), "yr").agg(F.avg("val").alias("ivt"), F.avg("u").alias("iwv"), F.avg("q").alias("q"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, lat0 double, lat1 double, lon0 double, lon1 double")


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window string, y0 int, y1 int")


def r(x: str) -> str:
    """A computed number in SQL as ``edge`` rounds it."""
    return f"round(({x}) + 0.000000001, 6)"
