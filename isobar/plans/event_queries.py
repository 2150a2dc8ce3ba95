"""Thresholds to events, what is added to events, and period summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import edge, wavelike_day
from isobar.operators import components, detection, events, grid, quantiles, shards, windows
from isobar.plans.base import FLAT_SQL, flat, r, read
from isobar.session import materialize, new_folder

PERIODS = [("early", "1995-01-01", "1997-12-31"), ("late", "1998-01-01", "2001-12-31")]


def _ts(c):
    return F.col(c).cast("timestamp_ntz")


def exceedance_events(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one user's events above the 85th percentile of their type and hour."""
    rows = read(spark, d, "events").withColumn("hour", F.hour("ts"))
    clim = grid.quantile_climatology(rows, ["event_type", "hour"], "value")
    marked = grid.threshold(rows, clim, ["event_type", "hour"], "value", 1.0)
    runs = windows.islands(marked, ["user_id"], "event_id", F.col("exceeds"))
    return runs.groupBy("user_id", "island").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.avg("value").alias("mean_intensity"), F.max("value").alias("max_intensity"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def q_entry_event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Climatology, threshold, runs, events, summary by week."""
    found = exceedance_events(spark, d)
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1000000.0
    found = found.withColumn("duration_h", seconds / 3600).withColumn("week", F.floor((F.dayofyear("start_time") - 1) / 7).cast("int"))
    return found.groupBy("week").agg(F.count(F.lit(1)).alias("n_events"), edge(F.avg("mean_intensity")).alias("mean_intensity"), edge(F.avg("max_intensity")).alias("mean_max_intensity"), edge(F.avg("duration_h")).alias("mean_duration_h"))


_EXCEED = """e AS (SELECT *, hour(ts) AS h FROM events), c AS (SELECT event_type, h, quantile_cont(value, 0.85) AS lim FROM e GROUP BY event_type, h),
m AS (SELECT e.*, value > greatest(lim, 1.0) AS f FROM e JOIN c USING (event_type, h)),
b AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY event_id), FALSE) THEN 1 ELSE 0 END AS b FROM m),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b),
v AS (SELECT user_id, island, min(ts) AS s, max(ts) AS t, avg(value) AS m, max(value) AS x, count(*) AS n FROM g WHERE f GROUP BY user_id, island HAVING count(*) >= 2)"""


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lineitem as voxels of their order's event."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), _ts("l_shipdate").alias("ts"), (25.0 + F.col("l_suppkey") % 36).alias("lat"), (210.0 + F.col("l_partkey") % 40).alias("lon"), F.col("l_quantity").alias("intensity"), F.when((F.col("l_suppkey") + F.col("l_partkey")) % 3 == 0, 1.0).otherwise(0.2).alias("land_sea_mask"), "l_discount", "l_tax")


_VOX = """vox AS (SELECT l_orderkey AS event_id, l_shipdate AS ts, CAST(25 + l_suppkey % 36 AS DOUBLE) AS lat, CAST(210 + l_partkey % 40 AS DOUBLE) AS lon, l_quantity AS intensity,
  CASE WHEN (l_suppkey + l_partkey) % 3 = 0 THEN 1.0 ELSE 0.2 END AS land, l_discount, l_tax FROM lineitem)"""
_AREA = "111.0 * 111.0 * cos(radians(lat))"


def q_event_table(spark: SparkSession, d: str) -> DataFrame:
    out = events.event_table(_voxels(spark, d), [], 1.0, 1.0)
    return out.select("event_id", "start_time", "end_time", *[edge(c).alias(c) for c in ("duration_hours", "mean_intensity", "max_intensity", "footprint_area_km2", "landfall_lat", "landfall_lon")])


def q_event_footprint(spark: SparkSession, d: str) -> DataFrame:
    out = events.footprints(_voxels(spark, d), [], 1.0, 1.0)
    return out.select("event_id", *[edge(c).alias(c) for c in ("footprint_area_km2", "landfall_lat", "landfall_lon")])


def q_event_features(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d)
    out = events.attach_features(v.select("event_id").distinct(), v, ["l_discount", "l_tax"], [])
    return out.select("event_id", *[edge(c).alias(c) for c in ("l_discount", "l_tax", "lat_deg", "doy_sin", "doy_cos")])


def _static(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' balances as terrain by place; places without any are missing."""
    s = read(spark, d, "supplier").select((25.0 + F.col("s_suppkey") % 36).alias("lat"), (210.0 + F.col("s_suppkey") * 3 % 40).alias("lon"), "s_acctbal")
    return s.groupBy("lat", "lon").agg(F.avg("s_acctbal").alias("elevation_m")).withColumn("land_sea_mask", F.when(F.col("elevation_m") > 0, 1.0).otherwise(0.0))


_STATIC = """st AS (SELECT CAST(25 + s_suppkey % 36 AS DOUBLE) AS lat, CAST(210 + s_suppkey * 3 % 40 AS DOUBLE) AS lon, avg(s_acctbal) AS elev FROM supplier GROUP BY 1, 2)"""


def q_event_topo(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d)
    out = events.attach_terrain(v.select("event_id").distinct(), v, _static(spark, d), [])
    return out.select("event_id", *[edge(c).alias(c) for c in ("mean_elev_m", "max_elev_m", "std_elev_m", "land_fraction")])


def q_event_precip(spark: SparkSession, d: str) -> DataFrame:
    """Users' runs as events; purchases of any user in the same cell (user modulo 20) as rain."""
    found = exceedance_events(spark, d).withColumn("event_id", F.col("user_id") * 100000 + F.col("island"))
    cells = found.select("event_id", (F.col("user_id") % 20).cast("double").alias("lat"), (F.col("user_id") % 3).cast("double").alias("lon"))
    rain = read(spark, d, "events").where("event_type = 'purchase'").select("ts", (F.col("user_id") % 20).cast("double").alias("lat"), (F.col("user_id") % 3).cast("double").alias("lon"), (F.col("value") / 1000).alias("tp"))
    out = events.attach_precip(found.select("event_id", "start_time", "end_time"), cells, rain, [])
    return out.select("event_id", edge("precip_total_mm").alias("precip_total_mm"))


def q_period_contrast(spark: SparkSession, d: str) -> DataFrame:
    table = events.event_table(_voxels(spark, d), [], 1.0, 1.0)
    periods = spark.createDataFrame(PERIODS, "period string, start string, end string")
    out = events.period_summary(events.period_of("start_time", periods, table))
    return out.select("period", "n_events", *[edge(c).alias(c) for c in ("mean_intensity", "mean_max_intensity", "mean_footprint_km2", "mean_duration_h")])


def q_period_bands(spark: SparkSession, d: str) -> DataFrame:
    """Period means of intensity and duration with their bootstrap bands over the events."""
    table = events.event_table(_voxels(spark, d), [], 1.0, 1.0)
    rows = events.period_of("start_time", spark.createDataFrame(PERIODS, "period string, start string, end string"), table)
    out = events.period_summary(rows).join(F.broadcast(events.period_bands(rows, [])), "period")
    return out.select("period", "n_events", *[edge(c).alias(c) for c in ("mean_intensity", "mean_duration_h", "intensity_q05", "intensity_q95", "duration_q05", "duration_q95")])


def q_period_shards(spark: SparkSession, d: str) -> DataFrame:
    """Events written by period and chunk of years, states merged: counts, means and exact quantiles of a period."""
    table = events.event_table(_voxels(spark, d), [], 1.0, 1.0)
    rows = events.period_of("start_time", spark.createDataFrame(PERIODS, "period string, start string, end string"), table)
    rows = materialize(rows.withColumn("chunk", F.year("start_time").cast("string")), "period-events")
    root = new_folder(spark, "period-shards")
    for r in rows.select("period", "chunk").distinct().orderBy("period", "chunk").collect():  # a job each, as jobs of their own would do
        shards.write_chunk(rows.where((F.col("period") == r.period) & (F.col("chunk") == r.chunk)), root, r.period, r.chunk)
    found = shards.bands(spark, root, ["mean_intensity", "duration_hours"], [0.05, 0.5, 0.95])
    wide = found.groupBy("period").agg(*[edge(F.max(F.when((F.col("metric") == m) & (F.col("q") == q), F.col("value")))).alias(f"{n}_q{int(100 * q):02d}") for n, m in (("intensity", "mean_intensity"), ("duration", "duration_hours")) for q in (0.05, 0.5, 0.95)])
    means = shards.summary(spark, root)
    return means.join(wide, "period").select("period", "n_events", *[edge(c).alias(c) for c in ("mean_intensity", "mean_max_intensity", "mean_footprint_area_km2", "mean_duration_hours")], *[c for c in wide.columns if c != "period"])


def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Yearly means by place: steps up, first and last years' quartile bands, verdict."""
    rows = flat(spark, d)
    means = rows.groupBy("y", "yr").agg(F.avg("val").alias("m"), F.percentile("val", F.lit(0.25)).alias("lo"), F.percentile("val", F.lit(0.75)).alias("hi"))
    up = windows.monotone(means, ["y"], "yr", "m")
    ends = means.groupBy("y").agg(*[f(c, "yr").alias(f"{c}{i}") for i, f in ((0, F.min_by), (1, F.max_by)) for c in ("lo", "hi")])
    out = up.join(ends, "y").withColumn("separate", events.bands_separate(F.col("lo0"), F.col("hi0"), F.col("lo1"), F.col("hi1")))
    w = Window.partitionBy("y").orderBy("yr")
    steps = means.select("y", events.bands_separate(F.lag("lo").over(w), F.lag("hi").over(w), F.col("lo"), F.col("hi")).alias("apart"), "yr", "m")
    steps = steps.groupBy("y").agg(F.coalesce(F.bool_or("apart"), F.lit(False)).alias("any_separate"), (F.max_by("m", "yr") - F.min_by("m", "yr")).alias("change"))
    mark = events.verdict(F.col("monotone"), F.col("separate"), F.col("any_separate"), F.col("change"))
    return out.join(steps, "y").select("y", "monotone", "separate", "any_separate", edge("change").alias("change"), mark.alias("verdict"))


def _grid_voxels(spark: SparkSession, d: str, n: int, q: float) -> DataFrame:
    """Cells of monthly sums above a quantile, on an n by n grid."""
    rows = read(spark, d, "lineitem").groupBy(((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("it"), (F.col("l_suppkey") % n).cast("int").alias("iy"), (F.col("l_partkey") % n).cast("int").alias("ix")).agg(F.sum("l_quantity").alias("s"))
    rows = materialize(rows, "grid-sums")
    limit = quantiles.quantile(rows, [], "s", q, "_limit")  # one row
    return rows.crossJoin(F.broadcast(limit)).where("s > _limit").select("it", "iy", "ix")


def _grid_sql(n: int, q: float) -> str:
    return f"""s AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS it, CAST(l_suppkey % {n} AS INTEGER) AS iy, CAST(l_partkey % {n} AS INTEGER) AS ix, sum(l_quantity) AS s
  FROM lineitem GROUP BY ALL),
k AS (SELECT it, iy, ix, (it * {n} + iy) * {n} + ix AS id FROM s WHERE s > (SELECT quantile_cont(s, {q}) FROM s))"""


def q_components_2d(spark: SparkSession, d: str) -> DataFrame:
    out = components.components_2d(_grid_voxels(spark, d, 12, 0.75), ["it"])
    return out.groupBy("it", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("iy") * 12 + F.col("ix")).alias("first"))


def q_components_3d(spark: SparkSession, d: str) -> DataFrame:
    out = components.components_3d(_grid_voxels(spark, d, 12, 0.94), [], chunk=16)
    sizes = out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("it").alias("first"), F.max("it").alias("last"))
    low = out.agg(F.min("iy").alias("y0"), F.min("ix").alias("x0"), (F.max("iy") - F.min("iy") + 1).alias("ny"), (F.max("ix") - F.min("ix") + 1).alias("nx"))
    at = sizes.crossJoin(F.broadcast(low))
    # The raster number as one of the whole 12 by 12 grid.
    x, rest = F.col("part") % F.col("nx"), F.floor(F.col("part") / F.col("nx"))
    return at.select(((F.floor(rest / F.col("ny")) * 12 + rest % F.col("ny") + F.col("y0")) * 12 + x + F.col("x0")).cast("long").alias("part"), "n", "first", "last")


def _object_cells(spark: SparkSession, d: str) -> DataFrame:
    """Monthly means of lineitem on a grid of 8 by 16 places as slices of transport."""
    iy, ix = (F.col("l_suppkey") % 8).cast("int"), (F.col("l_partkey") % 16).cast("int")
    rows = read(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("day"), iy.alias("iy"), ix.alias("ix"))
    rows = rows.agg(F.avg("l_quantity").alias("ivt_u"), F.avg(F.col("l_tax") * 500).alias("ivt_v"))
    month = F.month("day")
    place = [(20.0 + 5 * F.col("iy")).alias("lat"), (150.0 + 5 * F.col("ix")).alias("lon")]
    land = F.when((F.col("iy") + F.col("ix")) % 3 == 0, 1.0).otherwise(0.2).alias("land_sea_mask")
    return rows.select(_ts("day").alias("ts"), month.alias("month"), ((F.year("day") - 1995) * 12 + month - 1).alias("it"), "iy", "ix", *place, "ivt_u", "ivt_v", F.hypot("ivt_u", "ivt_v").alias("ivt"), land)


def _detected(spark: SparkSession, d: str) -> DataFrame:
    rows, by = _object_cells(spark, d), ["month", "iy", "ix"]
    return detection.detect_events(rows, grid.quantile_climatology(rows, by, "ivt"), by, 20.0).withColumn("intensity", F.col("ivt"))


def q_detect_events(spark: SparkSession, d: str) -> DataFrame:
    """Climatology, threshold, shape filter, events and what is added to them."""
    found = materialize(_detected(spark, d), "detected")
    table = events.attach_features(events.event_table(found, [], 5.0, 5.0), found, ["ivt_u", "ivt_v"], [])
    numbers = ("duration_hours", "mean_intensity", "max_intensity", "footprint_area_km2", "landfall_lat", "landfall_lon", "ivt_u", "ivt_v", "lat_deg", "doy_sin", "doy_cos")
    return table.select("event_id", "start_time", "end_time", *[edge(c).alias(c) for c in numbers])


def q_detect_periods(spark: SparkSession, d: str) -> DataFrame:
    """The detected events' counts and means by period, with bootstrap bands."""
    table = events.event_table(materialize(_detected(spark, d), "detected"), [], 5.0, 5.0)
    rows = events.period_of("start_time", spark.createDataFrame(PERIODS, "period string, start string, end string"), table)
    out = events.period_summary(rows).join(F.broadcast(events.period_bands(rows, [])), "period")
    return out.select("period", "n_events", *[edge(c).alias(c) for c in out.columns if c not in ("period", "n_events")])


def q_delta_change(spark: SparkSession, d: str) -> DataFrame:
    """1995's months plus the change of the monthly means from 1996-1997 to 1999-2000."""
    rows = flat(spark, d)
    clim = lambda a, b: rows.where(F.col("yr").between(a, b)).groupBy("mo", "y", "x").agg(F.avg("u").alias("u"))
    base = rows.where("yr = 1995").select("mo", "y", "x", "u")
    out = events.delta_change(base, clim(1996, 1997), clim(1999, 2000), ["mo", "y", "x"], ["u"])
    return out.select("mo", "y", "x", edge("u").alias("u"))


def q_cyclic_day(spark: SparkSession, d: str) -> DataFrame:
    sine, cosine = wavelike_day("o_orderdate")
    return read(spark, d, "orders").groupBy(F.dayofyear("o_orderdate").alias("doy")).agg(F.count(F.lit(1)).alias("n"), edge(F.avg(sine)).alias("doy_sin"), edge(F.avg(cosine)).alias("doy_cos"))


QUERIES = {f.__name__: f for f in (q_period_shards, q_entry_event_summary, q_event_table, q_event_footprint, q_event_features, q_event_topo, q_event_precip, q_period_contrast, q_period_bands, q_verdict, q_components_2d, q_components_3d, q_detect_events, q_detect_periods, q_delta_change, q_cyclic_day)}

_TABLE = f"""f AS (SELECT event_id, sum({_AREA}) AS area, avg(lat) FILTER (land > 0.5) AS la, avg(lon) FILTER (land > 0.5) AS lo
  FROM (SELECT event_id, lat, lon, max(land) AS land FROM vox GROUP BY ALL) GROUP BY event_id),
t AS (SELECT event_id, min(ts) AS s, max(ts) AS e, avg(intensity) AS m, max(intensity) AS x, date_diff('second', min(ts), max(ts)) / 3600.0 + 6 AS h FROM vox GROUP BY event_id HAVING count(*) >= 2)"""
_TAU = 2 * math.pi / 365.25
_REACH = """RECURSIVE {base}, r AS (SELECT it, id, id AS root, iy, ix FROM k UNION SELECT k.it, k.id, r.root, k.iy, k.ix FROM r JOIN k ON {near}),
l AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""

ORACLE = {
    "q_entry_event_summary": f"""WITH {_EXCEED} SELECT CAST(floor((dayofyear(s) - 1) / 7) AS INTEGER) AS week, count(*) AS n_events, {r('avg(m)')} AS mean_intensity, {r('avg(x)')} AS mean_max_intensity,
{r("avg((epoch_us(t) - epoch_us(s)) / 1000000.0 / 3600)")} AS mean_duration_h FROM v GROUP BY 1""",
    "q_event_table": f"WITH {_VOX}, {_TABLE} SELECT event_id, s AS start_time, e AS end_time, {r('h')} AS duration_hours, {r('m')} AS mean_intensity, {r('x')} AS max_intensity, {r('area')} AS footprint_area_km2, {r('la')} AS landfall_lat, {r('lo')} AS landfall_lon FROM t JOIN f USING (event_id)",
    "q_event_footprint": f"WITH {_VOX}, {_TABLE} SELECT event_id, {r('area')} AS footprint_area_km2, {r('la')} AS landfall_lat, {r('lo')} AS landfall_lon FROM f",
    "q_event_features": f"""WITH {_VOX}, a AS (SELECT event_id, avg(l_discount) AS d, avg(l_tax) AS t FROM vox GROUP BY event_id), l AS (SELECT event_id, avg(lat) AS lat
  FROM (SELECT DISTINCT event_id, lat FROM vox) GROUP BY event_id),
m AS (SELECT event_id, dayofyear(make_timestamp(CAST(floor(avg(epoch_us(ts))) AS BIGINT))) - 1 AS k FROM (SELECT DISTINCT event_id, ts FROM vox) GROUP BY event_id)
SELECT event_id, {r('d')} AS l_discount, {r('t')} AS l_tax, {r('lat')} AS lat_deg, {r(f'sin({_TAU!r} * k)')} AS doy_sin, {r(f'cos({_TAU!r} * k)')} AS doy_cos FROM a JOIN l USING (event_id) JOIN m USING (event_id)""",
    "q_event_topo": f"""WITH {_VOX}, {_STATIC}, c AS (SELECT event_id, elev FROM (SELECT DISTINCT event_id, lat, lon FROM vox) JOIN st USING (lat, lon)),
s AS (SELECT event_id, avg(elev) AS a, max(elev) AS m, stddev_pop(elev) AS s, avg(CASE WHEN elev > 0 THEN 1.0 ELSE 0.0 END) AS f FROM c GROUP BY event_id)
SELECT v.event_id, {r('a')} AS mean_elev_m, {r('m')} AS max_elev_m, {r('s')} AS std_elev_m, {r('f')} AS land_fraction FROM (SELECT DISTINCT event_id FROM vox) v LEFT JOIN s USING (event_id)""",
    "q_event_precip": f"""WITH {_EXCEED}, rain AS (SELECT ts, user_id % 20 AS la, user_id % 3 AS lo, value / 1000 AS tp FROM events WHERE event_type = 'purchase')
SELECT v.user_id * 100000 + CAST(v.island AS BIGINT) AS event_id, {r('coalesce(sum(tp), 0) * 1000')} AS precip_total_mm
FROM v LEFT JOIN rain ON rain.la = v.user_id % 20 AND rain.lo = v.user_id % 3 AND rain.ts BETWEEN v.s AND v.t + INTERVAL 6 HOURS GROUP BY 1""",
    "q_period_contrast": f"""WITH {_VOX}, {_TABLE}, p(period, a, b) AS (VALUES ('early', TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01'), ('late', TIMESTAMP '1998-01-01', TIMESTAMP '2002-01-01'))
SELECT period, count(*) AS n_events, {r('avg(m)')} AS mean_intensity, {r('avg(x)')} AS mean_max_intensity, {r('avg(area)')} AS mean_footprint_km2, {r('avg(h)')} AS mean_duration_h
FROM t JOIN f USING (event_id) JOIN p ON s >= a AND s < b GROUP BY period""",
    "q_period_shards": f"""WITH {_VOX}, {_TABLE}, p(period, a, b) AS (VALUES ('early', TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01'), ('late', TIMESTAMP '1998-01-01', TIMESTAMP '2002-01-01'))
SELECT period, count(*) AS n_events, {r('avg(m)')} AS mean_intensity, {r('avg(x)')} AS mean_max_intensity, {r('avg(area)')} AS mean_footprint_area_km2, {r('avg(h)')} AS mean_duration_hours,
  {', '.join(f"{r(f'quantile_cont({c}, {q})')} AS {n}_q{int(100 * q):02d}" for n, c in (('intensity', 'm'), ('duration', 'h')) for q in (0.05, 0.5, 0.95))}
FROM t JOIN f USING (event_id) JOIN p ON s >= a AND s < b GROUP BY period""",
    "q_verdict": f"""WITH {FLAT_SQL}, m AS (SELECT y, yr, avg(val) AS m, quantile_cont(val, 0.25) AS lo, quantile_cont(val, 0.75) AS hi FROM flat GROUP BY y, yr),
u AS (SELECT y, bool_and(coalesce(up, TRUE)) AS monotone FROM (SELECT y, m >= lag(m) OVER (PARTITION BY y ORDER BY yr) AS up FROM m) GROUP BY y),
e AS (SELECT y, arg_min(lo, yr) AS lo0, arg_min(hi, yr) AS hi0, arg_max(lo, yr) AS lo1, arg_max(hi, yr) AS hi1 FROM m GROUP BY y), s AS (SELECT y, monotone, lo1 > hi0 OR lo0 > hi1 AS separate FROM u JOIN e USING (y)),
t AS (SELECT y, coalesce(bool_or(lo > ph OR pl > hi), FALSE) AS any_separate, arg_max(m, yr) - arg_min(m, yr) AS change
  FROM (SELECT *, lag(lo) OVER (PARTITION BY y ORDER BY yr) AS pl, lag(hi) OVER (PARTITION BY y ORDER BY yr) AS ph FROM m) GROUP BY y)
SELECT y, monotone, separate, any_separate, {r('change')} AS change, CASE WHEN monotone AND separate THEN 'INTENSIFIED' WHEN NOT any_separate AND abs(change) < 5 THEN 'FLAT' ELSE 'MIXED' END AS verdict
  FROM s JOIN t USING (y)""",
    "q_components_2d": "WITH " + _REACH.format(base=_grid_sql(12, 0.75), near="k.it = r.it AND abs(k.iy - r.iy) <= 1 AND abs(k.ix - r.ix) <= 1") + """
SELECT it, CAST(dense_rank() OVER (PARTITION BY it ORDER BY root) AS INTEGER) AS part, n, root % 144 AS first FROM (SELECT k.it, l.root, count(*) AS n FROM k JOIN l USING (id) GROUP BY ALL)""",
    "q_components_3d": "WITH " + _REACH.format(base=_grid_sql(12, 0.94), near="abs(k.it - r.it) <= 1 AND abs(k.iy - r.iy) <= 1 AND abs(k.ix - r.ix) <= 1") + """
SELECT CAST(l.root AS BIGINT) AS part, count(*) AS n, min(k.it) AS first, max(k.it) AS last FROM k JOIN l USING (id) GROUP BY 1""",
    "q_delta_change": f"""WITH {FLAT_SQL}, h AS (SELECT mo, y, x, avg(u) AS u FROM flat WHERE yr BETWEEN 1996 AND 1997 GROUP BY ALL), f AS (SELECT mo, y, x, avg(u) AS u
  FROM flat WHERE yr BETWEEN 1999 AND 2000 GROUP BY ALL)
SELECT b.mo, b.y, b.x, {r('b.u + f.u - h.u')} AS u FROM flat b JOIN h USING (mo, y, x) JOIN f USING (mo, y, x) WHERE b.yr = 1995""",
    "q_cyclic_day": f"SELECT CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, count(*) AS n, {r(f'avg(sin({_TAU!r} * dayofyear(o_orderdate)))')} AS doy_sin, {r(f'avg(cos({_TAU!r} * dayofyear(o_orderdate)))')} AS doy_cos FROM orders GROUP BY 1",
}
