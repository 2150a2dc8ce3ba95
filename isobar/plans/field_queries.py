"""Slices, vertical integrals, climatologies and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import edge, in_season, lon180, lon360
from isobar.operators import grid, quantiles
from isobar.plans.base import CELLS_SQL, CUBE_SQL, FLAT_SQL, REGIONS_SQL, cells, cube, flat, r, read, regions
from isobar.session import materialize

G = 9.80665


def q_bbox_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select((25.0 + F.col("l_suppkey") % 36).alias("lat"), (F.col("l_partkey") % 360).cast("double").alias("lon"), "l_shipdate", "l_quantity")
    rows = grid.whole_days(grid.box(rows, (40.0, 30.0), (300.0, 60.0)), "l_shipdate", "1996-03-01", "1999-11-30")
    return rows.groupBy("lat").agg(F.count(F.lit(1)).alias("n"), edge(F.avg("l_quantity")).alias("mean_u"))


def q_harmonise(spark: SparkSession, d: str) -> DataFrame:
    lon = (F.col("o_custkey") * 7 % 360 - 180).cast("double")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), lon360(lon).alias("lon"), lon180(lon360(lon)).alias("lon_signed"), F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice")).alias("_v"))
    return rows.select("cell", "lon", "lon_signed", edge("_v").alias("value"))


def q_merge_levels(spark: SparkSession, d: str) -> DataFrame:
    noisy = cells(spark, d).withColumn("p", F.col("p") + F.when(F.col("x") % 2 == 0, 0.004).otherwise(-0.004))
    out = grid.merge_levels(noisy, "p", ["y"], ["q", "u"])
    return out.select("y", "p", edge("q").alias("q"), edge("u").alias("u"))


def q_vertical_integral(spark: SparkSession, d: str) -> DataFrame:
    out = grid.vertical_integral(cube(spark, d), ["yr", "mo", "y", "x"], sign=-1)
    return out.select("yr", "mo", "y", "x", *[edge(c).alias(c) for c in ("ivt_u", "ivt_v", "ivt", "iwv")])


_TRAPEZOID = f"(coalesce(p - lag(p) OVER c, 0) + coalesce(lead(p) OVER c - p, 0)) / (2 * {G})"


def q_layer_weights(spark: SparkSession, d: str) -> DataFrame:
    ps = cube(spark, d).withColumn("ps", 50.0 + 150.0 * ((F.col("y") + F.col("x")) % 5))
    out = grid.layer_weights(ps, ["yr", "mo", "y", "x"])
    return out.select("yr", "mo", "y", "x", "p", edge("w").alias("w"))


def q_region_year_series(spark: SparkSession, d: str) -> DataFrame:
    columns = grid.vertical_integral(cube(spark, d), ["yr", "mo", "y", "x"])
    inside = grid.box_join(columns, regions(spark), "y", "x").withColumn("w", F.cos(F.radians(10.0 * F.col("y"))))
    months = inside.groupBy("region", "yr", "mo").agg(grid.weighted_mean("ivt", "w").alias("ivt"), grid.weighted_mean("iwv", "w").alias("iwv"))
    return months.groupBy("region", "yr").agg(edge(F.avg("ivt")).alias("ivt"), edge(F.avg("iwv")).alias("iwv"))


def q_unit_weights(spark: SparkSession, d: str) -> DataFrame:
    places = flat(spark, d).groupBy("y", "x").agg(F.avg("u").alias("u"), F.count(F.lit(1)).alias("n"))
    out = grid.unit_weights(places, ["y"], F.cos(F.radians(5.0 * F.col("x"))), F.col("u") > 25.4)
    return out.select("y", "x", edge("aw").alias("aw"))


def q_weighted_active_mean(spark: SparkSession, d: str) -> DataFrame:
    out = grid.active_mean(flat(spark, d), ["yr"], "q", "val")
    return out.select("yr", edge("q_active").alias("q_active"))


def q_clim_quantile(spark: SparkSession, d: str) -> DataFrame:
    out = grid.quantile_climatology(cells(spark, d), ["mo", "y", "x"], "val")
    return out.select("mo", "y", "x", edge("clim").alias("clim"))


def q_clim_mean_anomaly(spark: SparkSession, d: str) -> DataFrame:
    out = grid.anomaly(flat(spark, d), ["mo", "y", "x"], "u")
    return out.select("yr", "mo", "y", "x", edge("anom").alias("anom"), edge("anom_norm").alias("anom_norm"))


def q_six_hour_sum(spark: SparkSession, d: str) -> DataFrame:
    out = grid.tumbling_sum(read(spark, d, "events"), "ts", "value", ["event_type"])
    return out.select("event_type", "start", edge("value").alias("value"))


def q_threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = flat(spark, d)
    out = grid.threshold(rows, grid.quantile_climatology(rows, ["mo", "y", "x"], "u"), ["mo", "y", "x"], "u", 26.0)
    return out.select("yr", "mo", "y", "x", edge("limit").alias("limit"), "exceeds")


def q_fixed_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).withColumn("exceeds", F.col("u") > F.lit(45.0))
    return rows.groupBy("mo", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exceeds").cast("long")).alias("n_exceeds"))


def q_composites(spark: SparkSession, d: str) -> DataFrame:
    out = cells(spark, d).groupBy("y", "x", "p").agg(*[edge(F.avg(e)).alias(n) for n, e in (("q", F.col("q")), ("u", F.col("u")), ("qu", F.col("q") * F.col("u")), ("qv", F.col("q") * F.col("v")))])
    return out


def q_season_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = flat(spark, d)
    change = lambda s: F.avg(F.when(in_season("mo", s) & (F.col("yr") >= 1999), F.col("val"))) - F.avg(F.when(in_season("mo", s) & (F.col("yr") <= 1997), F.col("val")))
    return rows.groupBy("y").agg(*[edge(change(s)).alias(s.lower()) for s in ("DJF", "MAM", "JJA", "SON", "ALL")])


def q_global_share(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted mean of each place against the mean of all."""
    places = flat(spark, d).groupBy("y", "x").agg(F.avg("val").alias("val")).withColumn("w", F.cos(F.radians(10.0 * F.col("y"))))
    whole = places.agg(grid.weighted_mean("val", "w").alias("_mean"), F.sum(F.col("val") * F.col("w")).alias("_sum"))
    return places.crossJoin(F.broadcast(whole)).select("y", "x", edge(F.col("val") - F.col("_mean")).alias("anom"), edge(F.col("val") * F.col("w") / F.col("_sum")).alias("share"))


def q_scale_limits(spark: SparkSession, d: str) -> DataFrame:
    """Upper percentiles of absolute anomalies, as colour scales use them."""
    a = grid.anomaly(flat(spark, d), ["mo", "y", "x"], "val")
    # Each row of places has a third of all values at most: exact quantiles without a task that holds them all.
    found = quantiles.exact(materialize(a.select("y", F.abs("anom").alias("size")), "anomalies"), ["y"], ["size"], [0.95, 0.98, 0.99])
    return found.groupBy("y").agg(*[edge(F.max(F.when(F.col("q") == q, F.col("value")))).alias(n) for n, q in (("p95", 0.95), ("p98", 0.98), ("p99", 0.99))])


def q_stride(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums thinned to every sixth hour by their own cadence."""
    hourly = grid.tumbling_sum(read(spark, d, "events"), "ts", "value", [], 1)
    return grid.stride(hourly, "start", 6).select("start", edge("value").alias("value"))


_IVT = f"""w AS (SELECT *, {_TRAPEZOID} AS w FROM cube WINDOW c AS (PARTITION BY yr, mo, y, x ORDER BY p)),
i AS (SELECT yr, mo, y, x, sum(q * u * w) AS iu, sum(q * v * w) AS iv, sum(q * w) AS iwv FROM w GROUP BY yr, mo, y, x)"""
_SEASONS = {"djf": "(12, 1, 2)", "mam": "(3, 4, 5)", "jja": "(6, 7, 8)", "son": "(9, 10, 11)", "all": "(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)"}

QUERIES = {f.__name__: f for f in (q_bbox_slice, q_harmonise, q_merge_levels, q_vertical_integral, q_layer_weights, q_region_year_series, q_unit_weights, q_weighted_active_mean, q_clim_quantile, q_clim_mean_anomaly, q_six_hour_sum, q_threshold_mask, q_fixed_threshold, q_composites, q_season_pivot, q_global_share, q_scale_limits, q_stride)}

ORACLE = {
    "q_bbox_slice": f"""SELECT CAST(25 + l_suppkey % 36 AS DOUBLE) AS lat, count(*) AS n, {r('avg(l_quantity)')} AS mean_u FROM lineitem
WHERE 25 + l_suppkey % 36 BETWEEN 30 AND 40 AND (l_partkey % 360 >= 300 OR l_partkey % 360 <= 60) AND l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1999-12-01' GROUP BY 1""",
    "q_harmonise": f"""SELECT o_orderkey AS cell, CAST((o_custkey * 7 % 360 + 180) % 360 AS DOUBLE) AS lon, CAST(o_custkey * 7 % 360 - 180 AS DOUBLE) AS lon_signed,
{r('CASE WHEN o_totalprice > 150000 THEN o_totalprice / 1000 ELSE o_totalprice END')} AS value FROM orders""",
    "q_merge_levels": f"SELECT y, round(p) AS p, {r('avg(q)')} AS q, {r('avg(u)')} AS u FROM ({CELLS_SQL}) GROUP BY 1, 2",
    "q_vertical_integral": f"WITH {CUBE_SQL}, {_IVT} SELECT yr, mo, y, x, {r('-iu')} AS ivt_u, {r('-iv')} AS ivt_v, {r('sqrt(iu * iu + iv * iv)')} AS ivt, {r('iwv')} AS iwv FROM i",
    "q_layer_weights": f"""WITH {CUBE_SQL}, a AS (SELECT *, CAST(50 + 150 * ((y + x) % 5) AS DOUBLE) AS ps FROM cube),
b AS (SELECT *, lag(p) OVER c AS p0, lead(p) OVER c AS p1 FROM a WHERE p <= ps WINDOW c AS (PARTITION BY yr, mo, y, x ORDER BY p)),
w AS (SELECT yr, mo, y, x, p, (coalesce(p - p0, 0) + coalesce(p1 - p, 2 * (ps - p))) / (2 * {G}) AS w FROM b)
SELECT a.yr, a.mo, a.y, a.x, a.p, {r('coalesce(w.w, 0)')} AS w FROM a LEFT JOIN w USING (yr, mo, y, x, p)""",
    "q_region_year_series": f"""WITH {CUBE_SQL}, {REGIONS_SQL}, {_IVT},
m AS (SELECT region, yr, mo, sum(sqrt(iu * iu + iv * iv) * cos(radians(10.0 * y))) / sum(cos(radians(10.0 * y))) AS ivt, sum(iwv * cos(radians(10.0 * y))) / sum(cos(radians(10.0 * y))) AS iwv
  FROM i JOIN regions ON y BETWEEN lat0 AND lat1 AND x BETWEEN lon0 AND lon1 GROUP BY region, yr, mo)
SELECT region, yr, {r('avg(ivt)')} AS ivt, {r('avg(iwv)')} AS iwv FROM m GROUP BY region, yr""",
    "q_unit_weights": f"""WITH {FLAT_SQL}, p AS (SELECT y, x, CASE WHEN avg(u) > 25.4 THEN cos(radians(5.0 * x)) ELSE 0 END AS w FROM flat GROUP BY y, x)
SELECT y, x, {r('w / nullif(sum(w) OVER (PARTITION BY y), 0)')} AS aw FROM p""",
    "q_weighted_active_mean": f"""WITH {FLAT_SQL}, l AS (SELECT yr, quantile_cont(val, 0.6) AS lim FROM flat GROUP BY yr)
SELECT yr, {r('sum(CASE WHEN val > lim THEN q * val ELSE 0 END) / sum(CASE WHEN val > lim THEN val ELSE 0 END)')} AS q_active FROM flat JOIN l USING (yr) GROUP BY yr""",
    "q_clim_quantile": f"SELECT mo, y, x, {r('quantile_cont(val, 0.85)')} AS clim FROM ({CELLS_SQL}) GROUP BY mo, y, x",
    "q_clim_mean_anomaly": f"""WITH {FLAT_SQL} SELECT yr, mo, y, x, {r('u - avg(u) OVER w')} AS anom, {r('(u - avg(u) OVER w) / nullif(stddev_pop(u) OVER w, 0)')} AS anom_norm
  FROM flat WINDOW w AS (PARTITION BY mo, y, x)""",
    "q_six_hour_sum": f"SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, {r('sum(value)')} AS value FROM events GROUP BY 1, 2",
    "q_threshold_mask": f"""WITH {FLAT_SQL}, c AS (SELECT mo, y, x, quantile_cont(u, 0.85) AS clim FROM flat GROUP BY mo, y, x)
SELECT yr, mo, y, x, {r('greatest(clim, 26.0)')} AS "limit", u > greatest(clim, 26.0) AS exceeds FROM flat JOIN c USING (mo, y, x)""",
    "q_fixed_threshold": f"SELECT mo, y, count(*) AS n, count(*) FILTER (u > 45) AS n_exceeds FROM ({CELLS_SQL}) GROUP BY mo, y",
    "q_composites": f"SELECT y, x, p, {r('avg(q)')} AS q, {r('avg(u)')} AS u, {r('avg(q * u)')} AS qu, {r('avg(q * v)')} AS qv FROM ({CELLS_SQL}) GROUP BY y, x, p",
    "q_season_pivot": f"WITH {FLAT_SQL} SELECT y, " + ", ".join(f"{r(f'avg(val) FILTER (mo IN {m} AND yr >= 1999) - avg(val) FILTER (mo IN {m} AND yr <= 1997)')} AS \"{s}\"" for s, m in _SEASONS.items()) + " FROM flat GROUP BY y",
    "q_global_share": f"""WITH {FLAT_SQL}, p AS (SELECT y, x, avg(val) AS val, cos(radians(10.0 * y)) AS w FROM flat GROUP BY y, x), g AS (SELECT sum(val * w) / sum(w) AS m, sum(val * w) AS s FROM p)
SELECT y, x, {r('val - m')} AS anom, {r('val * w / s')} AS share FROM p, g""",
    "q_scale_limits": f"""WITH {FLAT_SQL}, a AS (SELECT y, abs(val - avg(val) OVER (PARTITION BY mo, y, x)) AS a FROM flat)
SELECT y, {r('quantile_cont(a, 0.95)')} AS p95, {r('quantile_cont(a, 0.98)')} AS p98, {r('quantile_cont(a, 0.99)')} AS p99 FROM a GROUP BY y""",
    "q_stride": f"""WITH h AS (SELECT date_trunc('hour', ts) AS start, sum(value) AS value FROM events GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY start) - 1 AS i FROM h)
SELECT CAST(start AS TIMESTAMP) AS start, {r('value')} AS value FROM s WHERE i % 6 = 0""",
}
