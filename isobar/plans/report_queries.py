"""Frames behind reports: geometry, member terms, fingerprints, fold means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import edge, ratio
from isobar.operators import geometry, trees, trends
from isobar.operators import decomposition as dec
from isobar.plans.base import CELLS_SQL, FLAT_SQL, cells, flat, r, read

#: Outlines on the plane of the surrogate points (polygon, seq, x, y).
OUTLINES = [("a", 0, 212.0, 26.0), ("a", 1, 230.0, 30.0), ("a", 2, 226.0, 48.0), ("a", 3, 215.0, 40.0), ("b", 0, 225.0, 35.0), ("b", 1, 249.0, 35.5), ("b", 2, 237.0, 59.0)]


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", (25.0 + F.col("c_custkey") * 37 % 353 / 10).alias("lat"), (210.0 + F.col("c_custkey") % 401 / 10).alias("lon"))


def q_land_mask(spark: SparkSession, d: str) -> DataFrame:
    edges = geometry.polygon_edges(spark.createDataFrame(OUTLINES, "polygon string, seq int, x double, y double"))
    return geometry.inside(_points(spark, d), edges, ["c_custkey"])


def q_kde_2d(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(20).select((212.0 + F.col("id") % 5 * 8).alias("gx"), (28.0 + F.floor(F.col("id") / 5) * 8).cast("double").alias("gy"))
    out = geometry.kde_2d(_points(spark, d), grid, "lon", "lat", 0.25)
    return out.select("gx", "gy", F.round(F.col("density") * 1000 + 1e-9, 6).alias("density"))


def q_member_terms(spark: SparkSession, d: str) -> DataFrame:
    """Two-term change of each member between two periods, per unit of the change of its mean tax in percent."""
    li = read(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("yr"), "l_extendedprice", "l_quantity", "l_tax")
    late = F.col("yr") >= 1999
    mean = lambda c, t: F.avg(F.when(t, F.col(c)))
    m = li.groupBy("l_suppkey").agg(*[mean(c, t).alias(f"{n}{i}") for c, n in (("l_extendedprice", "ivt"), ("l_quantity", "iwv"), ("l_tax", "t")) for i, t in ((0, ~late), (1, late))])
    out = m.select("l_suppkey", *dec.two_term(), (100 * (F.col("t1") - F.col("t0"))).alias("dt")).where("abs(dt) > 0.0001")
    return out.select("l_suppkey", edge(100 * ratio("dynamic", "total")).alias("dynamic_percent"), edge(ratio("total", "dt"), 3).alias("per_kelvin"))


def q_first_members(spark: SparkSession, d: str) -> DataFrame:
    """The first three suppliers of each nation, and how many there are."""
    s = read(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    k = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    n = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("k", k).where("k <= 3").join(n, "s_nationkey").select("s_nationkey", "s_suppkey", "k", "n")


def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Three checks of the trend in efficiency (value over u) of each row of places: its season, its place, its drivers."""
    rows = flat(spark, d)
    month = rows.groupBy("y", "yr", "mo").agg(*[F.avg(c).alias(c) for c in ("val", "u", "q", "v")]).withColumn("eff", ratio("val", "u"))
    season = F.when(F.col("mo").isin(3, 4, 5), "pre").when(F.col("mo").isin(6, 7, 8, 9), "monsoon")
    years = month.withColumn("season", season).where("season IS NOT NULL").groupBy("y", "season", "yr").agg(F.avg("eff").alias("eff"))
    seasonal = trends.percent_trend(years, ["y", "season"], "yr", "eff").groupBy("y").agg(*[F.max(F.when(F.col("season") == s, F.col("trend"))).alias(s) for s in ("pre", "monsoon")])
    annual = month.groupBy("y", "yr").agg(*[F.avg(c).alias(c) for c in ("u", "q", "v", "eff")])
    long = annual.unpivot(["y", "yr"], ["u", "q", "v", "eff"], "driver", "value")
    places = rows.groupBy("y", "x", "yr").agg(ratio(F.avg("val"), F.avg("u")).alias("eff"))
    places = trends.percent_trend(places, ["y", "x"], "yr", "eff", least=6).withColumn("local", F.col("x") < 2)
    out = trends.fingerprint(seasonal, trends.percent_trend(long, ["y", "driver"], "yr", "value"), places, ["y"])
    checks = ["pre_monsoon_dominant", "igp_localised", "thermodynamically_unforced"]
    return out.select("y", *[edge(c, 4).alias(c) for c in ("pre", "monsoon", "local_median", "regional_median")], *checks, sum([F.col(c).cast("int") for c in checks], F.lit(0)).alias("n_checks"))


def q_lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Lag-one autocorrelation of detrended months, and the effective number of months."""
    rows = cells(spark, d).groupBy("y", ((F.col("yr") - 1995) * 12 + F.col("mo")).alias("m")).agg(F.avg("val").alias("v"))
    w = Window.partitionBy("y")
    resid = rows.withColumn("e", F.col("v") - F.regr_slope("v", "m").over(w) * F.col("m") - F.regr_intercept("v", "m").over(w))
    lagged = resid.withColumn("e1", F.lead("e").over(Window.partitionBy("y").orderBy("m")))
    out = lagged.groupBy("y").agg(F.corr("e", "e1").alias("r"), F.count(F.lit(1)).alias("n"))
    k = F.greatest(F.col("r"), F.lit(0.0))
    return out.select("y", edge("r").alias("r"), edge(F.col("n") * (1 - k) / (1 + k), 4).alias("n_eff"))


def q_fold_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean prediction of three fixed models over a feature table, and its exceedances."""
    shape = ([1, -1, 0, -1, -1], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0], [0.0, -5.0, 0.0, 2.0, 6.0], [0] * 5, [0.0] * 10)
    rows = [("fixed", 42, k, None, 0, ["q", "u"], 1.0, s, [0.0, 0.0], shape[0], [c, 0.0, 0.05, 0.0, 0.0], *shape[1:]) for k, (s, c) in enumerate(((100.0, 20.0), (200.0, 25.0), (300.0, 30.0)))]
    scored = trees.score_fold_mean(cells(spark, d).select("y", "mo", "q", "u"), spark.createDataFrame(rows, trees.SCHEMA), {None: "pred"})
    return scored.groupBy("y", "mo").agg(edge(F.avg("pred")).alias("pred"), F.sum((F.col("pred") > 202).cast("long")).alias("n"))


_F = (q_land_mask, q_kde_2d, q_member_terms, q_first_members, q_fingerprint, q_lag_correlation, q_fold_mean)
QUERIES = {f.__name__: f for f in _F}

_PTS = "pts AS (SELECT c_custkey, 25 + c_custkey * 37 % 353 / 10.0::DOUBLE AS lat, 210 + c_custkey % 401 / 10.0::DOUBLE AS lon FROM customer)"
ORACLE = {
    "q_land_mask": f"""WITH {_PTS}, v(polygon, seq, x, y) AS (VALUES {', '.join(f"('{p}', {s}, {x}::DOUBLE, {y}::DOUBLE)" for p, s, x, y in OUTLINES)}),
e AS (SELECT polygon, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY polygon ORDER BY seq)) AS x2, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY polygon ORDER BY seq)) AS y2
  FROM v WINDOW w AS (PARTITION BY polygon ORDER BY seq))
SELECT c_custkey, polygon FROM pts JOIN e ON (y1 <= lat AND y2 > lat OR y2 <= lat AND y1 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) GROUP BY ALL HAVING count(*) % 2 = 1""",
    "q_kde_2d": f"""WITH {_PTS}, s AS (SELECT count(*) AS n, var_samp(lon) AS a, covar_samp(lon, lat) AS b, var_samp(lat) AS c
  FROM pts), t AS (SELECT *, CASE WHEN n >= 5 AND a * c - b * b > 1e-9 * (a * c) THEN a * c - b * b END AS det FROM s),
g AS (SELECT 212 + i % 5 * 8.0::DOUBLE AS gx, 28 + i // 5 * 8.0::DOUBLE AS gy FROM range(20) r(i))
SELECT gx, gy, round(1000 * sum(exp(-0.5 * (c * (gx - lon) * (gx - lon) - 2 * b * (gx - lon) * (gy - lat) + a * (gy - lat) * (gy - lat)) / (det * 0.0625)) / (n * 2 * pi() * 0.0625 * sqrt(det))) + 0.000000001, 6) AS density
  FROM pts, t, g GROUP BY gx, gy""",
    "q_member_terms": f"""WITH x AS (SELECT l_suppkey, year(l_shipdate) >= 1999 AS l, l_extendedprice AS p, l_quantity AS q, l_tax AS t FROM lineitem),
m AS (SELECT l_suppkey, {', '.join(f'avg({c}) FILTER ({"" if i else "NOT "}l) AS {c}{i}' for c in 'pqt' for i in (0, 1))} FROM x
  GROUP BY l_suppkey), k AS (SELECT *, p1 - p0 AS total, p1 - p0 - p0 * (q1 / q0 - 1) AS dyn, 100 * (t1 - t0) AS dt FROM m)
SELECT l_suppkey, {r('100 * dyn / total')} AS dynamic_percent, round(total / dt + 0.000000001, 3) AS per_kelvin FROM k WHERE abs(dt) > 0.0001""",
    "q_first_members": "SELECT s_nationkey, s_suppkey, CAST(k AS INTEGER) AS k, n FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE k <= 3",
    "q_fingerprint": f"""WITH {FLAT_SQL}, m AS (SELECT y, yr, mo, avg(val) / avg(u) AS eff, avg(u) AS u, avg(q) AS q, avg(v) AS v FROM flat GROUP BY ALL),
sv AS (SELECT y, CASE WHEN mo IN (3, 4, 5) THEN 'pre' ELSE 'monsoon' END AS k, yr, avg(eff) AS v FROM m WHERE mo BETWEEN 3 AND 9 GROUP BY ALL),
an AS (SELECT y, yr, avg(u) AS u, avg(q) AS q, avg(v) AS v, avg(eff) AS eff FROM m GROUP BY ALL), dv AS (UNPIVOT an ON u, q, v, eff INTO NAME k VALUE v),
pv AS (SELECT y, x, yr, avg(val) / avg(u) AS v FROM flat GROUP BY ALL),
st AS (SELECT y, k, 1000 * s / m AS trend FROM (SELECT a.y, a.k, median((b.v - a.v) / (b.yr - a.yr)) AS s FROM sv a JOIN sv b ON a.y = b.y AND a.k = b.k AND a.yr < b.yr
  GROUP BY a.y, a.k) JOIN (SELECT y, k, avg(v) AS m FROM sv GROUP BY y, k) USING (y, k)),
dt AS (SELECT y, k, 1000 * s / m AS trend FROM (SELECT a.y, a.k, median((b.v - a.v) / (b.yr - a.yr)) AS s FROM dv a JOIN dv b ON a.y = b.y AND a.k = b.k AND a.yr < b.yr
  GROUP BY a.y, a.k) JOIN (SELECT y, k, avg(v) AS m FROM dv GROUP BY y, k) USING (y, k)),
pt AS (SELECT y, x, CASE WHEN n >= 6 THEN 1000 * s / m END AS trend FROM (SELECT a.y, a.x, median((b.v - a.v) / (b.yr - a.yr)) AS s FROM pv a
  JOIN pv b ON a.y = b.y AND a.x = b.x AND a.yr < b.yr GROUP BY a.y, a.x) JOIN (SELECT y, x, avg(v) AS m, count(*) AS n FROM pv GROUP BY y, x) USING (y, x)),
k AS (SELECT y, median(trend) FILTER (x < 2) AS l, median(trend) AS g FROM pt GROUP BY y), s AS (SELECT y, max(trend) FILTER (k = 'pre') AS pre, max(trend) FILTER (k = 'monsoon') AS mon FROM st GROUP BY y),
w AS (SELECT y, max(abs(trend)) FILTER (k = 'eff') AS e, max(abs(trend)) FILTER (k <> 'eff') AS o FROM dt GROUP BY y),
c AS (SELECT y, pre, mon, l, g, coalesce(pre > mon AND pre > 0, FALSE) AS a, coalesce(l > g, FALSE) AS b, coalesce(o < e / 2, FALSE) AS c FROM k LEFT JOIN s USING (y) LEFT JOIN w USING (y))
SELECT y, round(pre + 0.000000001, 4) AS pre, round(mon + 0.000000001, 4) AS monsoon, round(l + 0.000000001, 4) AS local_median, round(g + 0.000000001, 4) AS regional_median, a AS pre_monsoon_dominant, b AS igp_localised, c AS thermodynamically_unforced,
  CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS n_checks FROM c""",
    "q_lag_correlation": f"""WITH m AS (SELECT y, (yr - 1995) * 12 + mo AS m, avg(val) AS v FROM ({CELLS_SQL}) GROUP BY ALL), f AS (SELECT y, regr_slope(v, m) AS s, regr_intercept(v, m) AS i FROM m GROUP BY y),
e AS (SELECT m.y, m.m, v - s * m.m - i AS e, lead(v - s * m.m - i) OVER (PARTITION BY m.y ORDER BY m.m) AS e1 FROM m JOIN f USING (y)), k AS (SELECT y, corr(e, e1) AS r, count(*) AS n FROM e GROUP BY y)
SELECT y, {r('r')} AS r, round(n * (1 - greatest(r, 0)) / (1 + greatest(r, 0)) + 0.000000001, 4) AS n_eff FROM k""",
    "q_fold_mean": f"""WITH x AS (SELECT y, mo, ({' + '.join(f'{s} + CASE WHEN u <= {c} THEN -5.0 WHEN q <= 0.05 THEN 2.0 ELSE 6.0 END' for s, c in ((100, 20), (200, 25), (300, 30)))}) / 3.0::DOUBLE AS pred
  FROM ({CELLS_SQL}))
SELECT y, mo, {r('avg(pred)')} AS pred, count(*) FILTER (pred > 202) AS n FROM x GROUP BY y, mo""",
}
