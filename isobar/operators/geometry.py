"""Points in polygons and densities on planes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Points that a density needs, and how near to a line they may lie.
LEAST_POINTS, ON_A_LINE = 5, 1e-9


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """(polygon, x1, y1, x2, y2) of closed rings (polygon, seq, x, y)."""
    by = Window.partitionBy("polygon").orderBy("seq")
    whole = Window.partitionBy("polygon").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    return vertices.select("polygon", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def inside(points: DataFrame, edges: DataFrame, key: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """(key, polygon) of points inside, by the parity of the edges to their right.

    Edges are a mask's outline, a bounded table; an edge takes its lower end and
    not its upper one, so that no crossing counts twice.
    """
    spans = ((F.col("y1") <= F.col(y)) & (F.col("y2") > F.col(y))) | ((F.col("y2") <= F.col(y)) & (F.col("y1") > F.col(y)))
    at = F.col("x1") + (F.col(y) - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hits = points.join(F.broadcast(edges), spans).where(F.col(x) < at)
    return hits.groupBy(*key, "polygon").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(*key, "polygon")


def kde_2d(points: DataFrame, grid: DataFrame, x: str, y: str, factor: float, gx: str = "gx", gy: str = "gy") -> DataFrame:
    """Gaussian density at grid points; the kernel's covariance is the sample's times factor squared.

    Points with a null or NaN coordinate don't take part.  Fewer than ``LEAST_POINTS`` points, or
    points on a line (one minus their squared correlation within ``ON_A_LINE`` of zero), have a null density.
    """
    points = points.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).na.drop()
    stats = points.agg(F.count(x).alias("_n"), F.var_samp(x).alias("_a"), F.covar_samp(x, y).alias("_b"), F.var_samp(y).alias("_c"))
    both = F.col("_a") * F.col("_c")
    det = both - F.col("_b") * F.col("_b")
    det = F.when((F.col("_n") >= LEAST_POINTS) & (det > ON_A_LINE * both), det)
    stats = F.broadcast(stats.withColumn("_det", det))
    both = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).crossJoin(F.broadcast(grid.select(gx, gy))).crossJoin(stats)
    dx, dy = F.col(gx) - F.col("_x"), F.col(gy) - F.col("_y")
    f2 = factor * factor
    q = (F.col("_c") * dx * dx - 2 * F.col("_b") * dx * dy + F.col("_a") * dy * dy) / (F.col("_det") * f2)
    return both.groupBy(gx, gy).agg(F.sum(F.exp(-0.5 * q) / (F.col("_n") * 2 * math.pi * f2 * F.sqrt("_det"))).alias("density"))
