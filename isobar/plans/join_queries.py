"""Coordinate joins, set operations, folds, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import edge, region_key, right_closed_band, year_span
from isobar.operators import ensemble, grid, learning, windows
from isobar.plans.base import CELLS_SQL, FLAT_SQL, cells, flat, r, read


def _seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)


def q_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = _seconds(read(spark, d, "events"))
    left = rows.where("event_type = 'click'").select("event_id", "user_id", "s")
    right = rows.where("event_type = 'error'").select("user_id", "s", F.col("event_id").alias("near_id"))
    out = grid.nearest(left, right, "s", "near_id", 7200.0, ["user_id"])
    return out.select("event_id", "near_id", edge(F.abs(F.col("s") - F.col("nearest_s"))).alias("gap"))


def q_nearest_point(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations on a coarse axis, each with the nearest supplier balance on a grid of 1,000."""
    target = read(spark, d, "customer").select(F.floor(F.col("c_acctbal") / 250).cast("double").alias("a")).distinct()
    source = read(spark, d, "supplier").select(F.floor(F.col("s_acctbal") / 250).cast("double").alias("a")).distinct()
    return grid.nearest_axis(source, target, "a")


def q_bilinear(spark: SparkSession, d: str) -> DataFrame:
    places = flat(spark, d).groupBy(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "yr").agg(F.avg("val").alias("val"))
    target = spark.range(36).select((F.floor(F.col("id") / 6) * 0.75).alias("y"), (F.col("id") % 6 * 0.55).alias("x"))
    out = grid.bilinear(places, target, "y", "x", "val", ["yr"])
    return out.select("yr", edge("y").alias("y"), edge("x").alias("x"), edge("val").alias("val"))


def q_conservative(spark: SparkSession, d: str) -> DataFrame:
    places = flat(spark, d).groupBy("yr", "y", "x").agg(F.avg("val").alias("val"))
    bounds = [F.col(c).cast("double").alias(f"{c}_lo") for c in ("y", "x")]
    source = places.select("yr", "val", *bounds).withColumn("y_hi", F.col("y_lo") + 1).withColumn("x_hi", F.col("x_lo") + 1)
    target = spark.range(6).select((F.floor(F.col("id") / 2) * 1.6).alias("y_lo"), (F.floor(F.col("id") / 2) * 1.6 + 1.6).alias("y_hi"), (F.col("id") % 2 * 1.9).alias("x_lo"), (F.col("id") % 2 * 1.9 + 1.9).alias("x_hi"))
    out = grid.conservative(source, target, "y", "x", "val", ["yr"])
    return out.select("yr", edge("y_lo").alias("y_lo"), edge("x_lo").alias("x_lo"), edge("val").alias("val"))


def q_merge_override(spark: SparkSession, d: str) -> DataFrame:
    rows = flat(spark, d)
    a = rows.where("yr <= 1998").groupBy("mo", "y", "x").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    b = rows.where("yr >= 1998").groupBy("mo", "y", "x").agg(F.avg("u").alias("u"), F.avg("q").alias("q"))
    out = grid.merge_override(a.where("x < 3"), b.where("x > 0"), ["mo", "y", "x"])
    return out.select("mo", "y", "x", *[edge(c).alias(c) for c in ("u", "v", "q")])


def q_align_inner(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")).agg(F.avg("o_totalprice").alias("price"))
    e = cells(spark, d).groupBy("yr", "mo").agg(F.avg("u").alias("u"))
    return o.join(e, ["yr", "mo"]).select("yr", "mo", edge("price").alias("price"), edge("u").alias("u"))


def q_buffer_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points; blocks are those of the hash of one nation in five."""
    points = read(spark, d, "customer").select("c_custkey", (25.0 + F.col("c_custkey") % 353 / 10).alias("lat"), (210.0 + F.col("c_custkey") % 401 / 10).alias("lon"), "c_nationkey")
    blocks = read(spark, d, "nation").where("n_nationkey % 5 = 0").select((27.5 + F.col("n_nationkey") % 7 * 5).alias("block_lat"), (212.5 + F.col("n_nationkey") % 8 * 5).alias("block_lon"))
    return grid.outside_buffer(points, blocks, 1.0, 2.5).select("c_custkey", "lat", "lon")


def q_member_sets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers that shipped under every flag by year; those in 1996 but not in 2000 marked."""
    rows = read(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("yr"), "l_returnflag", "l_linestatus")
    whole = ensemble.complete_members(rows, ["l_suppkey", "yr"], "l_returnflag", ["A", "N", "R"])
    a, b = (rows.where((F.col("yr") == y) & (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).select("l_suppkey") for y in (1996, 2000))
    only = a.subtract(b).withColumn("only_1996", F.lit(True))
    both = a.intersect(b).withColumn("both", F.lit(True))
    n = whole.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_years"))
    out = n.join(only, "l_suppkey", "left").join(both, "l_suppkey", "left")
    return out.select("l_suppkey", "n_years", F.coalesce("only_1996", F.lit(False)).alias("only_1996"), F.coalesce("both", F.lit(False)).alias("both"))


def q_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").alias("o_orderdate"))


def q_union_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping periods of orders one after the other; the first period's day wins."""
    days = lambda a, b, src: read(spark, d, "orders").where(F.year("o_orderdate").between(a, b)).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("v")).withColumn("src", F.lit(src))
    both = days(1995, 1998, 1).unionByName(days(1997, 2001, 2).withColumn("v", F.col("v") * 2))
    return windows.first_by(both, ["day"], ["src"]).select("day", "src", edge("v", 2).alias("v"))


def q_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount")
    out = windows.stratified_sample(rows, (F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1), "id")
    return out.groupBy(((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1)).alias("positive")).agg(F.count(F.lit(1)).alias("n"))


def q_fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_quantity", (25.0 + F.col("l_suppkey") % 353 / 10).alias("lat"), (210.0 + F.col("l_partkey") % 401 / 10).alias("lon"))
    rows = rows.withColumn("block", learning.block_index("lat", "lon", 25.0, 210.0))
    out = learning.ranked_folds(rows, "block", F.avg(F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0)), 5)
    return out.groupBy("fold", "block").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_quantity").alias("y"), (0.8 * F.col("l_quantity") + 100 * F.col("l_discount")).alias("pred"), (F.col("l_quantity") * 0.7).alias("lo"), (F.col("l_quantity") * 0.9 + 60 * F.col("l_tax")).alias("hi"))


def q_fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = learning.regression_metrics(_scored(spark, d), ["fold"], "y", "pred", 40.0)
    return out.select("fold", *[edge(c).alias(c) for c in ("rmse", "r2", "precision", "recall", "f1")])


def q_pinball(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("fold").agg(edge(learning.pinball("y", "lo", 0.05)).alias("q05"), edge(learning.pinball("y", "pred", 0.5)).alias("q50"), edge(learning.pinball("y", "hi", 0.95)).alias("q95"), edge(learning.coverage("y", "lo", "hi")).alias("coverage"))


def q_band_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select((20.0 + F.col("l_quantity")).alias("lat"), "l_discount", "l_tax")
    band = right_closed_band("lat", [25.0, 35.0, 45.0, 60.0], ["south", "middle", "north"])
    return rows.select(band.alias("band"), (F.abs("l_discount") + F.abs("l_tax")).alias("s")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), edge(F.avg("s")).alias("mean"))


def q_region_key(spark: SparkSession, d: str) -> DataFrame:
    """Names as keys, and spans of years read from text."""
    first, last = year_span("span")
    rows = read(spark, d, "part").select("p_partkey", region_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("key"), F.when(F.col("p_size") % 2 == 0, F.concat(1940 + F.col("p_size"), F.lit("-"), 1990 + F.col("p_size"))).otherwise((1950 + F.col("p_size")).cast("string")).alias("span"))
    return rows.select("p_partkey", "key", first.alias("first"), last.alias("last"))


def q_missing_values(spark: SparkSession, d: str) -> DataFrame:
    """Means that skip missing values; divisions by zero give none."""
    rows = cells(spark, d).select("y", "mo", F.when(F.col("q") > 0.02, F.col("q")).alias("q"), F.col("u"), F.col("v"))
    return rows.groupBy("y", "mo").agg(F.count("q").alias("n"), edge(grid.weighted_mean("q", "u")).alias("mean"), edge(F.avg(F.try_divide(F.col("u"), F.col("v")))).alias("ratio"))


def q_fixed_order(spark: SparkSession, d: str) -> DataFrame:
    """Nations in a given order, those without suppliers kept, with the count among the region's."""
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("top"))
    both = n.join(s, n.n_nationkey == s.s_nationkey, "left")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc(F.coalesce("n", F.lit(0))), "n_nationkey"))
    return both.select("n_name", F.coalesce("n", F.lit(0)).alias("n"), "top", rank.alias("place"))


_F = (q_nearest_tolerance, q_nearest_point, q_bilinear, q_conservative, q_merge_override, q_align_inner, q_buffer_anti, q_member_sets, q_latest_version, q_union_dedupe_first, q_stratified_sample, q_fold_assignment, q_fold_metrics, q_pinball, q_band_bucket, q_region_key, q_missing_values, q_fixed_order)
QUERIES = {f.__name__: f for f in _F}

_SC = "s AS (SELECT l_orderkey % 5 AS fold, l_quantity AS y, 0.8 * l_quantity + 100 * l_discount AS pred, l_quantity * 0.7 AS lo, l_quantity * 0.9 + 60 * l_tax AS hi FROM lineitem)"
ORACLE = {
    "q_nearest_tolerance": f"""WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS s FROM events
  WHERE event_type = 'click'), e AS (SELECT event_id AS near_id, user_id, epoch_us(ts) / 1000000.0 AS s FROM events WHERE event_type = 'error'),
n AS (SELECT l.event_id, e.near_id, abs(l.s - e.s) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.s - e.s), e.s) AS k FROM l JOIN e ON l.user_id = e.user_id AND abs(l.s - e.s) <= 7200)
SELECT l.event_id, n.near_id, {r('n.gap')} AS gap FROM l LEFT JOIN n ON l.event_id = n.event_id AND n.k = 1""",
    "q_nearest_point": """WITH t AS (SELECT DISTINCT floor(c_acctbal / 250) AS target FROM customer), s AS (SELECT DISTINCT floor(s_acctbal / 250) AS source FROM supplier)
SELECT target, source FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY abs(target - source), source) AS k FROM t, s) WHERE k = 1""",
    "q_bilinear": f"""WITH {FLAT_SQL}, p AS (SELECT yr, y, x, avg(val) AS val FROM flat GROUP BY yr, y, x), t AS (SELECT CAST(i // 6 AS DOUBLE) * 0.75 AS ty, CAST(i % 6 AS DOUBLE) * 0.55 AS tx FROM range(36) r(i)),
w AS (SELECT yr, ty, tx, sum(val * greatest(1 - abs(ty - y), 0) * greatest(1 - abs(tx - x), 0)) AS val, sum(greatest(1 - abs(ty - y), 0) * greatest(1 - abs(tx - x), 0)) AS s FROM p, t GROUP BY yr, ty, tx)
SELECT yr, {r('ty')} AS y, {r('tx')} AS x, {r('val')} AS val FROM w WHERE s > 1 - 1e-9 AND ty <= 4 AND tx <= 3""",
    "q_conservative": f"""WITH {FLAT_SQL}, p AS (SELECT yr, y, x, avg(val) AS val FROM flat GROUP BY yr, y, x), t AS (SELECT CAST(i // 2 AS DOUBLE) * 1.6 AS a, CAST(i % 2 AS DOUBLE) * 1.9 AS b FROM range(6) r(i)),
w AS (SELECT yr, a, b, val, greatest(least(a + 1.6, y + 1.0) - greatest(a, y), 0) * greatest(least(b + 1.9, x + 1.0) - greatest(b, x), 0) AS k FROM p, t)
SELECT yr, {r('a')} AS y_lo, {r('b')} AS x_lo, {r('sum(val * k) / sum(k)')} AS val FROM w WHERE k > 0 GROUP BY yr, a, b""",
    "q_merge_override": f"""WITH {FLAT_SQL}, a AS (SELECT mo, y, x, avg(u) AS u, avg(v) AS v FROM flat WHERE yr <= 1998 AND x < 3
  GROUP BY ALL), b AS (SELECT mo, y, x, avg(u) AS u, avg(q) AS q FROM flat WHERE yr >= 1998 AND x > 0 GROUP BY ALL)
SELECT mo, y, x, {r('coalesce(a.u, b.u)')} AS u, {r('a.v')} AS v, {r('b.q')} AS q FROM a FULL JOIN b USING (mo, y, x)""",
    "q_align_inner": f"""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo, avg(o_totalprice) AS price FROM orders
  GROUP BY 1, 2), e AS (SELECT yr, mo, avg(u) AS u FROM ({CELLS_SQL}) GROUP BY yr, mo)
SELECT yr, mo, {r('price')} AS price, {r('u')} AS u FROM o JOIN e USING (yr, mo)""",
    "q_buffer_anti": """WITH p AS (SELECT c_custkey, 25 + c_custkey % 353 / 10.0::DOUBLE AS lat, 210 + c_custkey % 401 / 10.0::DOUBLE AS lon
  FROM customer), b AS (SELECT DISTINCT 27.5::DOUBLE + n_nationkey % 7 * 5 AS bl, 212.5::DOUBLE + n_nationkey % 8 * 5 AS bo FROM nation WHERE n_nationkey % 5 = 0)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE sqrt(power(greatest(abs(lat - bl) - 2.5, 0), 2) + power(greatest(abs(lon - bo) - 2.5, 0), 2)) < 1.0)""",
    "q_member_sets": """WITH x AS (SELECT l_suppkey, year(l_shipdate) AS yr, l_returnflag AS f, l_linestatus AS s FROM lineitem), w AS (SELECT l_suppkey, yr FROM x
  WHERE f IN ('A', 'N', 'R') GROUP BY ALL HAVING count(DISTINCT f) = 3),
a AS (SELECT DISTINCT l_suppkey FROM x WHERE yr = 1996 AND s = 'F' AND f = 'A'), b AS (SELECT DISTINCT l_suppkey FROM x WHERE yr = 2000 AND s = 'F' AND f = 'A')
SELECT l_suppkey, count(*) AS n_years, l_suppkey IN (FROM a) AND l_suppkey NOT IN (FROM b) AS only_1996, l_suppkey IN (FROM a) AND l_suppkey IN (FROM b) AS "both" FROM w GROUP BY l_suppkey""",
    "q_latest_version": "SELECT o_custkey, arg_max(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS latest, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey",
    "q_union_dedupe_first": """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v, 1 AS src FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 GROUP BY 1
UNION ALL SELECT CAST(o_orderdate AS DATE), sum(o_totalprice) * 2, 2 FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2001 GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY src) AS k FROM x)
SELECT day, CAST(src AS INTEGER) AS src, round(v + 0.000000001, 2) AS v FROM k WHERE k = 1""",
    "q_stratified_sample": """WITH n AS (SELECT count(*) AS a, count(*) FILTER (l_quantity >= 50 AND l_discount >= 0.1) AS p FROM lineitem) SELECT *
  FROM (SELECT TRUE AS positive, p AS n FROM n UNION ALL SELECT FALSE, least(3 * p, a - p) FROM n) WHERE n > 0""",
    "q_fold_assignment": """WITH x AS (SELECT l_quantity, CAST(floor((l_suppkey % 353 / 10.0::DOUBLE + 25 - 25) / 5) * 1000 + floor((l_partkey % 401 / 10.0::DOUBLE + 210 - 210) / 5) AS INTEGER) AS block
  FROM lineitem), b AS (SELECT block, avg(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM x GROUP BY block)
SELECT CAST((row_number() OVER (ORDER BY rate, block) - 1) % 5 AS INTEGER) AS fold, block, n FROM b""",
    "q_fold_metrics": f"""WITH {_SC}, m AS (SELECT fold, avg((y - pred) * (y - pred)) AS e, var_pop(y) AS v, count(*) FILTER (y > 40 AND pred > 40) AS tp, count(*) FILTER (y <= 40 AND pred > 40) AS fp, count(*) FILTER (y > 40 AND pred <= 40) AS fn
  FROM s GROUP BY fold),
k AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS q
  FROM m) SELECT fold, {r('sqrt(e)')} AS rmse, {r('1 - e / v')} AS r2, {r('p')} AS precision, {r('q')} AS recall, {r('2 * p * q / nullif(p + q, 0)')} AS f1 FROM k""",
    "q_pinball": f"WITH {_SC} SELECT fold, " + ", ".join(f"{r(f'avg(greatest({a} * (y - {c}), ({a} - 1) * (y - {c})))')} AS {n}" for a, c, n in ((0.05, "lo", "q05"), (0.5, "pred", "q50"), (0.95, "hi", "q95"))) + f", {r('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS coverage FROM s GROUP BY fold",
    "q_band_bucket": f"""SELECT CASE WHEN lat BETWEEN 25 AND 35 THEN 'south' WHEN lat > 35 AND lat <= 45 THEN 'middle' ELSE 'north' END AS band, count(*) AS n, {r('avg(s)')} AS mean
  FROM (SELECT 20 + l_quantity AS lat, abs(l_discount) + abs(l_tax) AS s FROM lineitem) WHERE lat BETWEEN 25 AND 60 GROUP BY 1""",
    "q_region_key": """SELECT p_partkey, regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]', '', 'g') AS key, CAST(CASE WHEN p_size % 2 = 0 THEN 1940 ELSE 1950 END + p_size AS INTEGER) AS first, CAST(CASE WHEN p_size % 2 = 0 THEN 1990 ELSE 1950 END + p_size AS INTEGER) AS last
  FROM part""",
    "q_missing_values": f"""WITH x AS (SELECT y, mo, CASE WHEN q > 0.02 THEN q END AS q, u, v
  FROM ({CELLS_SQL})) SELECT y, mo, count(q) AS n, {r('sum(q * u) / sum(CASE WHEN q IS NOT NULL THEN u END)')} AS mean, {r('avg(u / nullif(v, 0))')} AS ratio FROM x
  GROUP BY y, mo""",
    "q_fixed_order": """WITH s AS (SELECT s_nationkey, count(*) AS n, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS top FROM supplier GROUP BY 1)
SELECT n_name, coalesce(n, 0) AS n, top, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(n, 0) DESC, n_nationkey) AS INTEGER) AS place FROM nation LEFT JOIN s ON n_nationkey = s_nationkey""",
}
