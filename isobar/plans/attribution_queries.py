"""Modes of a field, what they explain of a series, index regressions and the checks made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import edge
from isobar.operators import decomposition as dec
from isobar.operators import modes, trends
from isobar.plans.base import CELLS_SQL, FLAT_SQL, WINDOWS, WINDOWS_SQL, YEARLY_SQL, cells, flat, r, read, yearly
from isobar.plans.model_queries import DLAT, DLON, NX, NY


def _field(spark: SparkSession, d: str) -> DataFrame:
    """Mean of lineitem's prices by month on a grid of 8 by 10 places."""
    rows = read(spark, d, "lineitem").select(
        ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("long").alias("time"), (25 + DLAT * (F.col("l_suppkey") % NY)).alias("lat"), (210 + DLON * (F.col("l_partkey") % NX)).alias("lon"), "l_extendedprice"
    )
    return rows.groupBy("time", "lat", "lon").agg(F.avg("l_extendedprice").alias("z"))


def _modes(spark: SparkSession, d: str, k: int = 3) -> modes.Modes:
    return modes.modes(_field(spark, d), "time", ["lat", "lon"], "z", "lat", k, ({"lat": 40.0, "lon": 230.0}, False))


def q_modes(spark: SparkSession, d: str) -> DataFrame:
    """Three leading modes: standardised series and shares, negative at 40 N, 230 E."""
    return _modes(spark, d).table(spark).select("mode", "time", edge("pc").alias("pc"), edge("share").alias("share"))


def q_mode_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _modes(spark, d).patterns().select("lat", "lon", "mode", edge("pattern", 4).alias("pattern"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """Transport, moisture and their ratio by corridor and month."""
    rows = cells(spark, d).groupBy(F.col("y").alias("corridor"), ((F.col("yr") - 1992) * 12 + F.col("mo")).cast("long").alias("m")).agg(F.avg("val").alias("ivt"), F.avg("u").alias("iwv"), F.avg("q").alias("q"))
    return rows.withColumn("vhat", F.try_divide("ivt", "iwv"))


def q_attribution(spark: SparkSession, d: str) -> DataFrame:
    """One row a corridor and mode: ridge, forest and trends."""
    found = _modes(spark, d)
    out = modes.attribution_rows(_series(spark, d), found.table(spark), "corridor", "m", "vhat", {"vhat": "vhat", "ivt": "ivt"}, modes.forest(20))
    return out.select("corridor", "term", "n", "top_mode", *[edge(c).alias(c) for c in out.columns if c not in ("corridor", "term", "n", "top_mode")])


def q_ridge_cv(spark: SparkSession, d: str) -> DataFrame:
    """R2 by contiguous blocks of a two-predictor ridge."""
    return modes.ridge_cv_sums(_series(spark, d), ["corridor"], "m", "vhat", "q", "iwv", 1.0).select("corridor", edge("r2").alias("r2"))


INDEX_WINDOWS = ((1995, 1997), (1999, 2001))


def _index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Yearly ratios by corridor with two indices that all corridors share."""
    series = _series(spark, d).withColumn("yr", (F.floor((F.col("m") - 1) / 12) + 1992).cast("int"))
    yearly = series.groupBy("corridor", "yr").agg(F.avg("vhat").alias("vhat"))
    index = cells(spark, d).groupBy("yr").agg(F.avg("q").alias("i1"), F.avg(F.when(F.col("x") < 2, F.col("u"))).alias("i2"))
    return yearly.join(F.broadcast(index), "yr")  # a row a year


def q_index_regression(spark: SparkSession, d: str) -> DataFrame:
    """Constant, trend and two indices by corridor, with the change between two windows that the indices leave."""
    out = trends.index_regression(_index_rows(spark, d), ["corridor"], "yr", "vhat", ["i1", "i2"], *INDEX_WINDOWS)
    return out.select("corridor", "label", *[edge(c, 4).alias(c) for c in ("coef", "se", "p", "corr", "corr_p", "r1_resid", "n_eff", "r2_full", "r2_indices", "diff_raw", "diff_index_removed")])


def q_welch_p(spark: SparkSession, d: str) -> DataFrame:
    """Welch's test between early and late months of each place, with its p."""
    rows = flat(spark, d).withColumn("w", F.when(F.col("yr") <= 1997, "early").when(F.col("yr") >= 1999, "late"))
    out = trends.student_p(trends.welch(rows.where("w is not null"), ["y", "x"], "w", "val", "early", "late"), "t", "df")
    return out.select("y", "x", edge("t").alias("t"), edge("df").alias("df"), edge("p").alias("p"))


def q_corr_p(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of two corridor series by calendar month, with its p."""
    out = trends.correlation_p(flat(spark, d).where("x < 2"), ["mo", "y"], "val", "u")
    return out.select("mo", "y", "n", edge("r").alias("r"), edge("p").alias("p"))


def q_window_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Each window's terms against the first window, in the order of windows."""
    means = dec.window_means(yearly(spark, d).withColumnRenamed("yr", "year"), spark.createDataFrame(WINDOWS, "window string, y0 int, y1 int"), ["corridor"], ["ivt", "iwv"])
    base = means.where("window = 'w1'").select("corridor", F.col("ivt").alias("ivt0"), F.col("iwv").alias("iwv0"))
    both = means.withColumnsRenamed({"ivt": "ivt1", "iwv": "iwv1"}).join(base, "corridor")
    terms = [c.alias(n) for c, n in zip(dec.three_term(), ("d_thermo", "d_dyn", "d_cov", "d_total"), strict=True)]
    out = both.select("corridor", F.col("window").alias("win"), F.col("ivt1").alias("ivt"), F.col("iwv1").alias("iwv"), *terms)
    return out.select("corridor", "win", *[edge(c).alias(c) for c in ("ivt", "iwv", "d_total", "d_thermo", "d_dyn", "d_cov")])


def q_moistening_rate(spark: SparkSession, d: str) -> DataFrame:
    """Change of moisture and transport in per cent, warming, the rate per kelvin and what 7 % per kelvin gives."""
    rows = cells(spark, d)
    mean = lambda c, late: F.avg(F.when((F.col("yr") >= 1999) if late else (F.col("yr") <= 1997), c))
    t = 280 + 100 * F.col("v")
    m = rows.groupBy(F.col("y").alias("corridor")).agg(*[mean(c, late).alias(f"{n}{int(late)}") for n, c in (("iwv", F.col("u")), ("ivt", F.col("val")), ("t", t)) for late in (False, True)])
    out = dec.moistening(m)
    return out.select("corridor", *[edge(c, 4).alias(c) for c in ("moist_percent", "ivt_percent", "warming", "rate", "expected")])


_F = (q_index_regression, q_welch_p, q_corr_p, q_window_evolution, q_moistening_rate, q_modes, q_mode_patterns, q_attribution, q_ridge_cv)
QUERIES = {f.__name__: f for f in _F}

_SERIES = f"s AS (SELECT y AS corridor, (yr - 1992) * 12 + mo AS m, avg(val) AS ivt, avg(u) AS iwv, avg(q) AS q, avg(val) / avg(u) AS vhat FROM ({CELLS_SQL}) GROUP BY ALL)"


def _p_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the angle, t being sqrt(df) times its tangent."""
    n = 2000
    f = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan(abs({t}) / sqrt({df})) * i / {n}), ({df}) - 1)"
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * atan(abs({t}) / sqrt({df})) / {3 * n} * list_sum(list_transform(range(0, {n + 1}), lambda i: {f})))"


(_A0, _A1), (_B0, _B1) = INDEX_WINDOWS
#: Detrended indices are orthogonal to the constant and the trend, so the fit falls into three parts.
_INDEX = f"""{_SERIES}, yv AS (SELECT corridor, CAST(floor((m - 1) / 12) AS INTEGER) + 1992 AS yr, avg(vhat) AS v FROM s GROUP BY ALL),
ix AS (SELECT yr, avg(q) AS i1, avg(u) FILTER (x < 2) AS i2 FROM ({CELLS_SQL}) GROUP BY yr),
g AS (SELECT corridor, yr, v, i1, i2, (yr - avg(yr) OVER w) / 10 AS t FROM yv JOIN ix USING (yr) WINDOW w AS (PARTITION BY corridor)),
dl AS (SELECT *, i1 - regr_intercept(i1, t) OVER w - regr_slope(i1, t) OVER w * t AS d1, i2 - regr_intercept(i2, t) OVER w - regr_slope(i2, t) OVER w * t AS d2 FROM g WINDOW w AS (PARTITION BY corridor)),
z AS (SELECT corridor, yr, v, i1, i2, t, d1 / stddev_samp(d1) OVER w AS z1, d2 / stddev_samp(d2) OVER w AS z2 FROM dl WINDOW w AS (PARTITION BY corridor)),
f AS (SELECT corridor, count(*) AS n, avg(v) AS b0, regr_slope(v, t) AS bt, sum(t * t) AS tt, sum(z1 * z1) AS aa, sum(z2 * z2) AS bb, sum(z1 * z2) AS ab, sum(z1 * v) AS av, sum(z2 * v) AS bv, corr(v, i1) AS c1, corr(v, i2) AS c2
  FROM z GROUP BY corridor),
h AS (SELECT *, aa * bb - ab * ab AS det, (av * bb - bv * ab) / (aa * bb - ab * ab) AS b1, (bv * aa - av * ab) / (aa * bb - ab * ab) AS b2 FROM f),
e AS (SELECT z.corridor, yr, v, b0, b1 * z1 + b2 * z2 AS part, v - b0 - bt * t - b1 * z1 - b2 * z2 AS e FROM z JOIN h USING (corridor)),
le AS (SELECT *, lead(e) OVER (PARTITION BY corridor ORDER BY yr) AS e1 FROM e),
o AS (SELECT corridor, corr(e, e1) AS r1, sum(e * e) AS ee, 1 - var_pop(e) / var_pop(v) AS r2_full, 1 - var_pop(v - part - b0) / var_pop(v) AS r2_indices,
  avg(v) FILTER (yr BETWEEN {_B0} AND {_B1}) - avg(v) FILTER (yr BETWEEN {_A0} AND {_A1}) AS diff_raw, avg(v - part) FILTER (yr BETWEEN {_B0} AND {_B1}) - avg(v - part) FILTER (yr BETWEEN {_A0} AND {_A1}) AS diff_index_removed
  FROM le GROUP BY corridor),
q AS (SELECT *, least(greatest(n * (1 - r1) / (1 + r1), 6), greatest(n, 6)) AS n_eff FROM h JOIN o USING (corridor)),
u AS (SELECT *, unnest(['const', 'trend_per_decade', 'i1', 'i2']) AS label, unnest([b0, bt, b1, b2]) AS coef, unnest([1 / CAST(n AS DOUBLE), 1 / tt, bb / det, aa / det]) AS inv, unnest([NULL, NULL, c1, c2]) AS corr
  FROM q),
k AS (SELECT *, sqrt(ee / (n_eff - 4) * inv * n / n_eff) AS se FROM u)"""
ORACLE = {
    "q_index_regression": f"""WITH {_INDEX} SELECT corridor, label, {', '.join(f"round({c} + 0.000000001, 4) AS {c}" for c in ('coef', 'se', 'corr', 'n_eff', 'r2_full', 'r2_indices', 'diff_raw', 'diff_index_removed'))}, round(r1 + 0.000000001, 4) AS r1_resid,
  round({_p_sql('coef / se', 'n_eff - 4')} + 0.000000001, 4) AS p, round({_p_sql('corr * sqrt((n - 2) / (1 - corr * corr))', 'n - 2')} + 0.000000001, 4) AS corr_p FROM k""",
    "q_welch_p": f"""WITH {FLAT_SQL}, w AS (SELECT y, x, {', '.join(f"{f}(val) FILTER ({c}) AS {n}{i}" for i, c in ((0, 'yr <= 1997'), (1, 'yr >= 1999')) for f, n in (('avg', 'm'), ('var_samp', 'v'), ('count', 'n')))}
  FROM flat GROUP BY y, x),
a AS (SELECT y, x, (m1 - m0) / sqrt(v0 / n0 + v1 / n1) AS t, pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)) AS df FROM w)
SELECT y, x, {r('t')} AS t, {r('df')} AS df, {r(_p_sql('t', 'df'))} AS p FROM a""",
    "q_corr_p": f"WITH {FLAT_SQL}, c AS (SELECT mo, y, count(*) AS n, corr(val, u) AS r FROM flat WHERE x < 2 GROUP BY mo, y) SELECT mo, y, n, {r('r')} AS r, {r(_p_sql('r * sqrt((n - 2) / (1 - r * r))', 'n - 2'))} AS p FROM c",
    "q_window_evolution": f"""WITH {YEARLY_SQL}, {WINDOWS_SQL}, m AS (SELECT corridor, win, avg(ivt) AS i, avg(iwv) AS w FROM yearly JOIN windows ON yr BETWEEN y0 AND y1 GROUP BY ALL)
SELECT a.corridor, a.win, {r('a.i')} AS ivt, {r('a.w')} AS iwv, {r('a.i - b.i')} AS d_total, {r('b.i / b.w * (a.w - b.w)')} AS d_thermo, {r('b.w * (a.i / a.w - b.i / b.w)')} AS d_dyn, {r('(a.w - b.w) * (a.i / a.w - b.i / b.w)')} AS d_cov
  FROM m a JOIN m b USING (corridor) WHERE b.win = 'w1'""",
    "q_moistening_rate": f"""WITH m AS (SELECT y AS corridor, {', '.join(f"avg({c}) FILTER ({k}) AS {n}{i}" for n, c in (('w', 'u'), ('i', 'val'), ('t', '280 + 100 * v')) for i, k in ((0, 'yr <= 1997'), (1, 'yr >= 1999')))}
  FROM ({CELLS_SQL}) GROUP BY y)
SELECT corridor, round(100 * (w1 / w0 - 1) + 0.000000001, 4) AS moist_percent, round(100 * (i1 / i0 - 1) + 0.000000001, 4) AS ivt_percent, round(t1 - t0 + 0.000000001, 4) AS warming, round(100 * (w1 / w0 - 1) / (t1 - t0) + 0.000000001, 4) AS rate, round(7 * (t1 - t0) + 0.000000001, 4) AS expected
  FROM m""",
    "q_ridge_cv": f"""WITH {_SERIES}, n AS (SELECT corridor, m, vhat AS y, q AS a, iwv AS b, row_number() OVER (PARTITION BY corridor ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY corridor) AS n FROM s),
f AS (SELECT n.*, k.k FROM n JOIN (SELECT unnest(range(5)) AS k) AS k ON n.i >= n.n * k.k // 5 AND n.i < n.n * (k.k + 1) // 5),
t AS (SELECT g.corridor, g.k, count(*) AS n, avg(f.y) AS my, avg(f.a) AS ma, avg(f.b) AS mb, var_pop(f.a) * count(*) + 1 AS aa, var_pop(f.b) * count(*) + 1 AS bb, covar_pop(f.a, f.b) * count(*) AS ab, covar_pop(f.a, f.y) * count(*) AS ay, covar_pop(f.b, f.y) * count(*) AS b_y
  FROM (SELECT DISTINCT corridor, k FROM f) AS g JOIN f ON f.corridor = g.corridor AND f.k <> g.k GROUP BY g.corridor, g.k),
c AS (SELECT corridor, k, my, ma, mb, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS ca, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM t),
e AS (SELECT f.corridor, f.y, my + ca * (f.a - ma) + cb * (f.b - mb) AS said FROM f JOIN c USING (corridor, k))
SELECT corridor, {r('1 - sum((y - said) * (y - said)) / (var_pop(y) * count(*))')} AS r2 FROM e GROUP BY corridor""",
}
