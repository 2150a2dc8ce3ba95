"""Ensemble tables, lists and zips of members, and rows as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import G, edge, scaled_round
from isobar.operators import decomposition as dec
from isobar.operators import ensemble, grid, training
from isobar.plans.base import CELLS_SQL, WINDOWS, WINDOWS_SQL, YEARLY_SQL, cells, r, read, yearly
from isobar.plans.statistics_queries import _MEM, _members
from isobar.session import new_folder
from isobar.sources import sinks


def _observed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("term")).agg((F.avg("l_extendedprice") - 38000 + 400).alias("obs"))


def q_weighted_stats(spark: SparkSession, d: str) -> DataFrame:
    """Members of all models, each model weighing the same, against an observation."""
    m = ensemble.model_weights(_members(spark, d), "model", ["term"])
    out = ensemble.weighted_stats(m, _observed(spark, d), ["term"])
    return out.select("term", "n_extreme", *[edge(c).alias(c) for c in ("weighted_mean", "obs", "extreme", "p05", "p95")])


def q_member_lists(spark: SparkSession, d: str) -> DataFrame:
    """Values of a model's members as one array, in the order of members; models without any value left out."""
    m = ensemble.drop_empty_models(_members(spark, d).withColumn("value", F.when(F.col("model") % 5 > 0, scaled_round("value", 4)).otherwise(0.0)), "model", "value")
    return ensemble.value_lists(m, ["model", "term"], "member", "value").select("model", "term", F.size("values").alias("n"), F.array_join(F.transform("values", lambda v: F.format_string("%.4f", v)), ",").alias("listed"))


def q_zip_series(spark: SparkSession, d: str) -> DataFrame:
    """Two series of a corridor's years side by side by position, though their years differ."""
    y = yearly(spark, d).where("yr < 1999")
    late = y.select("corridor", (F.col("yr") + 50).alias("year2"), F.col("iwv").alias("other"))
    return ensemble.zip_rows(y.select("corridor", "yr", "ivt"), late, ["corridor"], "yr", "year2").select("corridor", "yr", edge("ivt").alias("ivt"), edge("other").alias("other"))


def q_sorted_terms(spark: SparkSession, d: str) -> DataFrame:
    """Corridors in falling order of their change between the first and the last window."""
    y = yearly(spark, d)
    mean = lambda a, b: F.avg(F.when(F.col("yr").between(a, b), F.col("ivt")))
    change = y.groupBy("corridor").agg((mean(*WINDOWS[2][1:]) - mean(*WINDOWS[0][1:])).alias("change"))
    return change.select("corridor", edge("change").alias("change"), F.row_number().over(Window.orderBy(F.desc("change"), "corridor")).alias("place")).orderBy(F.desc("change"), "corridor")


def q_synoptic_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events at full synoptic hours, of a half of each year's steps."""
    rows = read(spark, d, "events").withColumn("step", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz"))
    return training.six_hourly(rows, "step", every=2).groupBy("step").agg(F.count(F.lit(1)).alias("n"), edge(F.avg("value")).alias("mean"))


def q_window_composites(spark: SparkSession, d: str) -> DataFrame:
    """Means of each window by place, written by window and read again."""
    w = F.broadcast(spark.createDataFrame(WINDOWS, "win string, y0 int, y1 int"))
    means = cells(spark, d).join(w, F.col("yr").between(F.col("y0"), F.col("y1"))).groupBy("win", "y", "x").agg(*[F.avg(c).alias(c) for c in ("q", "u", "val")])
    path = new_folder(spark, "composites")
    sinks.write_table(means, path, ["win"])
    return spark.read.parquet(path).select("y", "x", *[edge(c).alias(c) for c in ("q", "u", "val")], F.col("win").cast("string").alias("win"))


def q_three_levels(spark: SparkSession, d: str) -> DataFrame:
    """Integrals over three fixed levels with the fixed weights of a trapezoid from 250 to 850 hPa."""
    return grid.three_level_integral(cells(spark, d).where("p <= 300"), ["y", "yr"], "p", {100.0: 0, 200.0: 1, 300.0: 2}, "q").select("y", "yr", edge("q").alias("q"))


def q_sensitivity_lines(spark: SparkSession, d: str) -> DataFrame:
    """Changes between windows of two to four years and the years after, as table lines."""
    y = yearly(spark, d)
    spans = spark.createDataFrame([(b, n) for b in (1995, 1996) for n in (2, 3)], "base_start int, length int")
    mean = lambda lo, hi: F.avg(F.when((F.col("yr") >= lo) & (F.col("yr") < hi), F.col("iwv")))
    b, n = F.col("base_start"), F.col("length")
    rows = y.join(F.broadcast(spans), F.col("yr") >= b).groupBy("corridor", "base_start", "length").agg((100 * (mean(b + n, b + n + n) - mean(b, b + n))).alias("value"))
    rows = rows.where("NOT (base_start = 1996 AND length = 3 AND corridor = 2)").withColumn("p", F.when(F.abs("value") > 3, 0.01).otherwise(0.5)).withColumn("name", F.concat(F.lit("c"), F.col("corridor")))
    return sinks.sensitivity_lines(rows.withColumn("value", edge("value", 3)), "corridor", "name", [2, 3]).select("corridor", "base_start", F.col("value").alias("line"))


#: Levels that the members have: observations are reduced to the same ones.
MEMBER_LEVELS = (200, 400, 600)


def _member_terms(spark: SparkSession, d: str) -> DataFrame:
    """Level terms of six members (orders by number) and of all rows (member -1), over the members' levels, with the warming of each."""
    rows = read(spark, d, "lineitem").where((100 * F.col("l_linenumber")).isin(*MEMBER_LEVELS))
    rows = rows.select(
        F.explode(F.array((F.col("l_orderkey") % 6).cast("int"), F.lit(-1))).alias("member"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), (F.col("l_suppkey") % 5).cast("int").alias("corridor"),
        (F.col("l_partkey") % 4).cast("int").alias("cell"), (100 * F.col("l_linenumber")).cast("double").alias("p"), F.col("l_discount").alias("q"), F.col("l_quantity").alias("u"), F.col("l_tax").alias("v"),
    )
    months = rows.groupBy("member", "corridor", "cell", "year", "month", "p").agg(*[F.avg(c).alias(c) for c in ("q", "u", "v")], *[F.avg(F.col("q") * F.col(c)).alias(f"q{c}") for c in ("u", "v")])
    late = F.col("year") > 1997
    mean = lambda x: x.groupBy("member", "corridor", "cell", "month", "p").agg(*[F.avg(c).alias(c) for c in ("q", "u", "v", "qu", "qv")]).withColumn("w", F.lit(100.0) / G).withColumn("aw", (F.col("cell") + 1) / 10.0)
    terms = dec.level_terms(mean(months.where(~late)), mean(months.where(late)), ["member", "corridor"])
    warming = months.groupBy("member").agg((100 * (F.avg(F.when(late, F.col("v"))) - F.avg(F.when(~late, F.col("v"))))).alias("warming"))
    return terms.join(F.broadcast(warming), "member")  # a row a member


def q_member_level_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each member and corridor, and the total per kelvin of the member's warming."""
    out = _member_terms(spark, d)
    return out.select("member", "corridor", *[edge(c).alias(c) for c in ("moist", "wind", "cov", "trans", "total")], edge("warming").alias("warming"), edge(F.try_divide("total", "warming"), 3).alias("per_kelvin"))


def q_member_detection(spark: SparkSession, d: str) -> DataFrame:
    """Observed terms, reduced to the members' levels, against the members."""
    long = _member_terms(spark, d).unpivot(["member", "corridor"], ["wind", "moist", "total"], "term", "value")
    observed = long.where("member = -1").select("corridor", "term", F.col("value").alias("obs"))
    out = ensemble.ensemble_stats(long.where("member >= 0"), observed, ["corridor", "term"])
    return out.select("corridor", "term", "n", *[edge(c).alias(c) for c in ("mean", "sd", "obs", "extreme", "low", "high", "z")])


_F = (q_member_level_terms, q_member_detection, q_weighted_stats, q_member_lists, q_zip_series, q_sorted_terms, q_synoptic_steps, q_window_composites, q_three_levels, q_sensitivity_lines)
QUERIES = {f.__name__: f for f in _F}

_W = "w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY term, model) AS w FROM mem)"
_PAIRS = {"base": "a.q{c}", "later": "b.q{c}", "moist": "a.{c} * (b.q - a.q)", "wind": "a.q * (b.{c} - a.{c})", "cov": "(b.q - a.q) * (b.{c} - a.{c})", "trans": "((b.q{c} - a.q{c}) - (b.q * b.{c} - a.q * a.{c}))"}
_MEMBER_TERMS = f"""x AS (SELECT unnest([CAST(l_orderkey % 6 AS INTEGER), -1]) AS member, year(l_shipdate) AS yr, month(l_shipdate) AS mo, CAST(l_suppkey % 5 AS INTEGER) AS y, CAST(l_partkey % 4 AS INTEGER) AS x, l_linenumber AS p, l_discount AS q, l_quantity AS u, l_tax AS v
  FROM lineitem WHERE 100 * l_linenumber IN {MEMBER_LEVELS}),
mm AS (SELECT member, y, x, yr, mo, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(q * u) AS qu, avg(q * v) AS qv FROM x GROUP BY member, y, x, yr, mo, p),
a AS (SELECT member, y, x, mo, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(qu) AS qu, avg(qv) AS qv FROM mm WHERE yr <= 1997 GROUP BY member, y, x, mo, p),
b AS (SELECT member, y, x, mo, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(qu) AS qu, avg(qv) AS qv FROM mm WHERE yr > 1997 GROUP BY member, y, x, mo, p),
c AS (SELECT a.member, a.y, a.x, a.mo, {', '.join(f'sum(100.0 / {G} * {e.format(c=c)}) AS {n}_{c}' for c in 'uv' for n, e in _PAIRS.items())} FROM a JOIN b USING (member, y, x, mo, p) GROUP BY a.member, a.y, a.x, a.mo),
e AS (SELECT *, sqrt(base_u * base_u + base_v * base_v) AS s, (x + 1) / 10.0 AS aw FROM c),
n AS (SELECT member, y, mo, {', '.join(f'sum(CASE WHEN s > 0 THEN aw * ({t}_u * base_u + {t}_v * base_v) / s ELSE 0 END) AS {t}' for t in _PAIRS)} FROM e GROUP BY member, y, mo),
t AS (SELECT member, y AS corridor, {', '.join(f'avg({t}) AS {t}' for t in ('moist', 'wind', 'cov', 'trans'))}, avg(later) - avg(base) AS total FROM n GROUP BY member, y),
k AS (SELECT member, 100 * (avg(v) FILTER (yr > 1997) - avg(v) FILTER (yr <= 1997)) AS warming FROM mm GROUP BY member)"""
ORACLE = {
    "q_member_level_terms": f"WITH {_MEMBER_TERMS} SELECT member, corridor, {', '.join(f'{r(c)} AS {c}' for c in ('moist', 'wind', 'cov', 'trans', 'total', 'warming'))}, round(total / warming + 0.000000001, 3) AS per_kelvin FROM t JOIN k USING (member)",
    "q_member_detection": f"""WITH {_MEMBER_TERMS}, l AS (UNPIVOT (SELECT member, corridor, wind, moist, total FROM t) ON wind, moist, total INTO NAME term VALUE value),
o AS (SELECT corridor, term, value AS obs FROM l WHERE member = -1), m AS (SELECT corridor, term, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n, min(value) AS low, max(value) AS high
  FROM l WHERE member >= 0 GROUP BY corridor, term),
f AS (SELECT l.corridor, l.term, avg(CASE WHEN (CASE WHEN obs >= mean THEN value >= obs ELSE value <= obs END) THEN 1.0 ELSE 0.0 END) AS extreme FROM l
  JOIN o USING (corridor, term) JOIN m USING (corridor, term) WHERE member >= 0 GROUP BY l.corridor, l.term)
SELECT corridor, term, n, {', '.join(f'{r(c)} AS {c}' for c in ('mean', 'sd', 'obs', 'extreme', 'low', 'high'))}, {r('(obs - mean) / sd')} AS z FROM m JOIN o USING (corridor, term) JOIN f USING (corridor, term)""",
    "q_weighted_stats": f"""WITH {_MEM}, {_W}, o AS (SELECT l_returnflag AS term, avg(l_extendedprice) - 38000 + 400 AS obs FROM lineitem
  GROUP BY 1), m AS (SELECT term, sum(w * value) / sum(w) AS mean, sum(w) AS total FROM w GROUP BY term),
b AS (SELECT w.*, obs, mean, total, CASE WHEN obs >= mean THEN value >= obs ELSE value <= obs END AS beyond FROM w JOIN o USING (term)
  JOIN m USING (term)), c AS (SELECT term, value, sum(w) OVER (PARTITION BY term ORDER BY value RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY term) AS c FROM w),
q AS (SELECT term, min(value) FILTER (c >= 0.05 - 1e-12) AS p05, min(value) FILTER (c >= 0.95 - 1e-12) AS p95 FROM c GROUP BY term)
SELECT term, count(*) FILTER (beyond) AS n_extreme, {r('any_value(mean)')} AS weighted_mean, {r('any_value(obs)')} AS obs, {r('coalesce(sum(w) FILTER (beyond), 0) / any_value(total)')} AS extreme, {r('any_value(p05)')} AS p05, {r('any_value(p95)')} AS p95
  FROM b JOIN q USING (term) GROUP BY term""",
    "q_member_lists": f"WITH {_MEM} SELECT model, term, CAST(count(*) AS INTEGER) AS n, string_agg(printf('%.4f', round(value, 4)), ',' ORDER BY member) AS listed FROM mem WHERE model % 5 > 0 GROUP BY model, term",
    "q_zip_series": f"WITH {YEARLY_SQL} SELECT corridor, yr, {r('ivt')} AS ivt, {r('iwv')} AS other FROM yearly WHERE yr < 1999",
    "q_sorted_terms": f"""WITH {YEARLY_SQL}, c AS (SELECT corridor, avg(ivt) FILTER (yr BETWEEN {WINDOWS[2][1]} AND {WINDOWS[2][2]}) - avg(ivt) FILTER (yr BETWEEN {WINDOWS[0][1]} AND {WINDOWS[0][2]}) AS change
  FROM yearly GROUP BY corridor)
SELECT corridor, {r('change')} AS change, CAST(row_number() OVER (ORDER BY change DESC, corridor) AS INTEGER) AS place FROM c""",
    "q_synoptic_steps": f"""WITH e AS (SELECT date_trunc('hour', ts) AS step, value FROM events WHERE hour(ts) % 6 = 0),
s AS (SELECT step, row_number() OVER (PARTITION BY year(step) ORDER BY md5(strftime(step, '%Y-%m-%d %H') || ':42'), step) AS k, count(*) OVER (PARTITION BY year(step)) AS n FROM (SELECT DISTINCT step FROM e))
SELECT step, count(*) AS n, {r('avg(value)')} AS mean FROM e JOIN s USING (step) WHERE k <= s.n // 2 GROUP BY step""",
    "q_window_composites": f"WITH {WINDOWS_SQL} SELECT win, y, x, {', '.join(f'{r(f'avg({c})')} AS {c}' for c in ('q', 'u', 'val'))} FROM ({CELLS_SQL}) JOIN windows ON yr BETWEEN y0 AND y1 GROUP BY win, y, x",
    "q_three_levels": f"""WITH m AS (SELECT y, yr, p, avg(q) AS q FROM ({CELLS_SQL}) WHERE p <= 300 GROUP BY ALL)
SELECT y, yr, {r('sum(q * CASE p WHEN 100 THEN 12500 WHEN 200 THEN 30000 ELSE 17500 END) / 9.80665')} AS q FROM m GROUP BY y, yr HAVING count(*) = 3""",
    "q_sensitivity_lines": f"""WITH {YEARLY_SQL}, s(b, n) AS (VALUES (1995, 2), (1995, 3), (1996, 2), (1996, 3)),
v AS (SELECT corridor, b, n, 100 * (avg(iwv) FILTER (yr >= b + n AND yr < b + 2 * n) - avg(iwv) FILTER (yr >= b AND yr < b + n)) AS v FROM yearly, s GROUP BY ALL),
c AS (SELECT corridor, b, n, CASE WHEN v IS NULL THEN '-' ELSE printf('%+.1f', round(v + 0.000000001, 3)) END || CASE WHEN abs(v) > 3 THEN '*' ELSE '' END AS c FROM v WHERE NOT (b = 1996 AND n = 3 AND corridor = 2)),
w AS (SELECT corridor, b, coalesce(max(c) FILTER (n = 2), '--') AS a, coalesce(max(c) FILTER (n = 3), '--') AS z FROM c GROUP BY corridor, b)
SELECT corridor, CAST(b AS INTEGER) AS base_start, CASE WHEN row_number() OVER (PARTITION BY corridor ORDER BY b) = 1 THEN 'c' || corridor ELSE '' END || ' & ' || b || ' & ' || a || ' & ' || z || ' \\\\' AS line
  FROM w""",
}
