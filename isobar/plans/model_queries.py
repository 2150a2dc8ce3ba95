"""Folds, boosters, scenario scoring, attributions and training rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import edge, right_closed_band
from isobar.operators import boosting, folds, learning, scenarios, training, trees
from isobar.plans.base import r, read
from isobar.session import materialize, new_folder

# --- cells as a feature cube ------------------------------------------------------

NY, NX, DLAT, DLON = 8, 10, 2.5, 4.0


def feature_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lineitem as monthly cells of a feature cube on a grid of 8 by 10 places."""
    rows = read(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"), (F.col("l_suppkey") % NY).cast("int").alias("iy"), (F.col("l_partkey") % NX).cast("int").alias("ix"),
        "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice",
    )
    means = {
        "ivt": F.avg("l_quantity") * 10,
        "ivt_u": F.avg("l_discount") * 1000,
        "ivt_v": F.avg("l_tax") * 1000,
        "theta_e_850": 300 + F.avg("l_linenumber"),
        "pv_250": F.avg("l_extendedprice") / 10000,
        "eady_growth_rate": F.avg(F.col("l_discount") * F.col("l_quantity")),
    }
    cells = rows.groupBy("yr", "mo", "iy", "ix").agg(*[m.alias(c) for c, m in means.items()])
    return cells.withColumn("it", ((F.col("yr") - 1992) * 12 + F.col("mo")).cast("int")).withColumn("ts", F.make_timestamp_ntz("yr", "mo", F.lit(15), F.lit(0), F.lit(0), F.lit(0.0))).withColumn("lat", 25 + DLAT * F.col("iy")).withColumn("lon", 210 + DLON * F.col("ix"))


_CELLS = f"""cells AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, CAST(month(l_shipdate) AS INTEGER) AS mo, CAST(l_suppkey % {NY} AS INTEGER) AS iy, CAST(l_partkey % {NX} AS INTEGER) AS ix,
  avg(l_quantity) * 10 AS ivt, avg(l_discount) * 1000 AS ivt_u, avg(l_tax) * 1000 AS ivt_v, 300 + avg(l_linenumber) AS theta_e_850, avg(l_extendedprice) / 10000 AS pv_250,
  avg(l_discount * l_quantity) AS eady_growth_rate FROM lineitem GROUP BY ALL)"""


def _terrain(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' balances as terrain by place; places without any are missing."""
    places = read(spark, d, "supplier").groupBy((25 + DLAT * (F.col("s_suppkey") % NY)).alias("lat"), (210 + DLON * (F.col("s_suppkey") * 3 % NX)).alias("lon"))
    return places.agg(F.avg("s_acctbal").alias("elevation_m")).withColumn("land_sea_mask", F.when(F.col("elevation_m") > 4000, 1.0).otherwise(0.2))


# --- scoring ----------------------------------------------------------------------

#: Trees of the scored models as (feature, cut, leaf at or below, second feature, its cut, leaf at or below, leaf above, training rows of the three leaves).
STAGE1_TREES = [
    ("ivt", 231.3, -60.0, "pv_250", 3.777, 20.0, 64.5, (40, 35, 25)),
    ("eady_growth_rate", 1.2345, -20.0, "ivt_u", 51.7, 10.0, 31.0, (50, 30, 20)),
    ("lat_deg", 33.1, 6.0, "doy_cos", 0.123, -7.0, 9.5, (45, 30, 25)),
    ("theta_e_850", 303.03, -9.0, "ivt_v", 40.9, 12.0, -3.0, (60, 25, 15)),
]
STAGE2_TREES = [
    ("mean_intensity", 322.7, -4.0, "std_elev_m", 2222.2, 3.0, 8.5, (50, 30, 20)),
    ("landfall_lat", 35.55, 2.0, "max_intensity", 351.3, -1.5, 7.0, (30, 50, 20)),
    ("footprint_area_km2", 300003.3, -3.0, "duration_hours", 1000.1, 1.0, 6.5, (40, 40, 20)),
    ("land_fraction", 0.333, -2.5, "max_elev_m", 5555.5, 0.5, 4.5, (35, 35, 30)),
    ("landfall_lat", 38.05, -0.5, "mean_elev_m", 3999.9, 2.5, 5.0, (60, 20, 20)),
]
FOLDS, RATE1, RATE2, THRESHOLD = 3, 0.5, 0.5, 349.0
STARTS2 = {0.05: 5.0, 0.5: 20.0, 0.95: 60.0}


def _models(spark: SparkSession) -> DataFrame:
    """The fixed trees as a table of models; a fold has its own start and leaves shifted by its number."""
    rows = []

    def add(model: str, fold: int, alpha: float | None, n: int, features: list[str], rate: float, start: float, spec: tuple) -> None:
        a, cut_a, low, b, cut_b, mid, high, (n0, n1, n2) = spec
        values = [0.0, low + fold, 0.0, mid + fold, high + fold]
        cover = [n0 + n1 + n2, n0, n1 + n2, n1, n2]
        shape = ([features.index(a), -1, features.index(b), -1, -1], [cut_a, 0.0, cut_b, 0.0, 0.0], [1, 0, 3, 0, 0], [2, 0, 4, 0, 0])
        rows.append((model, 42, fold, alpha, n, features, rate, start, [0.0] * len(features), *shape, values, cover, [0.0] * (5 * len(features))))

    for fold in range(FOLDS):
        for n, spec in enumerate(STAGE1_TREES):
            add("stage1", fold, None, n, scenarios.STAGE1, RATE1, 280.0 + 10 * fold, spec)
        for alpha, start in STARTS2.items():
            for n, spec in enumerate(STAGE2_TREES):
                add("stage2", fold, alpha, n, scenarios.STAGE2, RATE2, start + fold, spec)
    return spark.createDataFrame(rows, trees.SCHEMA)


def _below(column: str, cut: float) -> str:
    """Columns of single precision are compared with a cut in double."""
    return f"CAST({column} AS DOUBLE) <= CAST({cut} AS DOUBLE)"


def _sum_sql(specs: list[tuple], rate: float, fold: int) -> str:
    return " + ".join(f"{rate} * CASE WHEN {_below(a, ca)} THEN {lo + fold} WHEN {_below(b, cb)} THEN {mid + fold} ELSE {hi + fold} END" for a, ca, lo, b, cb, mid, hi, _ in specs)


def _mean_sql(specs: list[tuple], rate: float, starts: list[float]) -> str:
    return "(" + " + ".join(f"({s} + {_sum_sql(specs, rate, f)})" for f, s in enumerate(starts)) + f") / CAST({len(starts)} AS DOUBLE)"


PAST, FUTURE = (1995, 1997), (1998, 2001)


def _years(df: DataFrame, span: tuple[int, int]) -> DataFrame:
    return df.where(F.col("yr").between(*span))


def q_score_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Both protocols over stored boosters: features, intensity, events, rainfall quantiles."""
    path = new_folder(spark, "models")
    trees.save(_models(spark), path)
    cells = feature_cells(spark, d)
    direct = _years(cells, FUTURE)
    delta = scenarios.delta_features(_years(cells, PAST), _years(cells, PAST), direct, ["iy", "ix"], "mo")
    both = direct.withColumn("mode", F.lit("direct")).unionByName(delta.withColumn("mode", F.lit("delta")))
    stage1, stage2 = (trees.load(spark, path, m, 42, list(range(FOLDS))) for m in ("stage1", "stage2"))
    out = scenarios.run(materialize(both.drop("yr", "mo"), "scenario-cells"), stage1, stage2, _terrain(spark, d), ["mode"], THRESHOLD, DLAT, DLON)
    numbers = ["mean_intensity", "max_intensity", "footprint_area_km2", "duration_hours", "landfall_lat", "lat_deg", "doy_sin", "ivt", "pv_250", "mean_elev_m", "land_fraction", *scenarios.QUANTILES.values()]
    return out.select("mode", "event_id", "start_time", *[edge(c).alias(c) for c in numbers])


def q_stage1_intensity(spark: SparkSession, d: str) -> DataFrame:
    """Intensity by cell from the mean over the folds' models, over all years."""
    models = _models(spark).where("model = 'stage1'")
    scored = scenarios.predict_intensity(scenarios.stage1_matrix(feature_cells(spark, d)), models)
    return scored.groupBy("iy", "ix").agg(F.count(F.lit(1)).alias("n"), edge(F.avg("ar_intensity")).alias("mean"), F.max("ar_intensity").cast("double").alias("most"), F.count_if(F.col("ar_intensity") > THRESHOLD).alias("n_above"))


_TAU = 2 * math.pi / 365.25
_M9 = ["ivt", "ivt_u", "ivt_v", "theta_e_850", "pv_250", "eady_growth_rate"]
_MATRIX = f"""m AS (SELECT mode, it, iy, ix, ts, 25 + {DLAT} * iy AS lat, 210 + {DLON} * ix AS lon, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in _M9)}, CAST(25 + {DLAT} * iy AS FLOAT) AS lat_deg,
  CAST(sin({_TAU!r} * dayofyear(ts)) AS FLOAT) AS doy_sin, CAST(cos({_TAU!r} * dayofyear(ts)) AS FLOAT) AS doy_cos FROM cube),
i AS (SELECT *, CAST({_mean_sql(STAGE1_TREES, RATE1, [280.0 + 10 * f for f in range(FOLDS)])} AS FLOAT) AS intensity FROM m)"""
_STAMPED = "(yr - 1992) * 12 + mo AS it, make_timestamp(CAST(yr AS BIGINT), CAST(mo AS BIGINT), 15, 0, 0, 0.0) AS ts"

SCENARIO_SQL = f"""WITH RECURSIVE {_CELLS},
past AS (SELECT mo, iy, ix, {', '.join(f'avg({c}) AS {c}' for c in _M9)} FROM cells WHERE yr BETWEEN {PAST[0]} AND {PAST[1]} GROUP BY ALL),
future AS (SELECT mo, iy, ix, {', '.join(f'avg({c}) AS {c}' for c in _M9)} FROM cells WHERE yr BETWEEN {FUTURE[0]} AND {FUTURE[1]} GROUP BY ALL),
cube AS (
  SELECT 'direct' AS mode, {_STAMPED}, iy, ix, {', '.join(_M9)} FROM cells WHERE yr BETWEEN {FUTURE[0]} AND {FUTURE[1]}
  UNION ALL SELECT 'delta', {_STAMPED}, iy, ix, {', '.join(f'c.{c} + (f.{c} - p.{c})' for c in _M9)} FROM cells c JOIN past p USING (mo, iy, ix) JOIN future f USING (mo, iy, ix) WHERE yr BETWEEN {PAST[0]} AND {PAST[1]}),
{_MATRIX},
k AS (SELECT *, (it * {NY} + iy) * {NX} + ix AS id FROM i WHERE intensity > {THRESHOLD}),
reach AS (SELECT mode, it, iy, ix, id, id AS root FROM k UNION SELECT k.mode, k.it, k.iy, k.ix, k.id, reach.root FROM reach
  JOIN k ON k.mode = reach.mode AND abs(k.it - reach.it) <= 1 AND abs(k.iy - reach.iy) <= 1 AND abs(k.ix - reach.ix) <= 1 WHERE k.id > reach.root),
root AS (SELECT mode, id, min(root) AS root FROM reach GROUP BY mode, id),
top AS (SELECT r.mode, r.id, min(s.root) AS root FROM root r JOIN root s ON r.mode = s.mode AND r.root = s.id GROUP BY r.mode, r.id),
ids AS (SELECT mode, root, row_number() OVER (PARTITION BY mode ORDER BY root) AS event_id FROM (SELECT DISTINCT mode, root FROM top)),
land AS (SELECT 25 + {DLAT} * (s_suppkey % {NY}) AS lat, 210 + {DLON} * (s_suppkey * 3 % {NX}) AS lon, avg(s_acctbal) AS elev FROM supplier GROUP BY 1, 2),
v AS (SELECT k.*, ids.event_id, CASE WHEN land.elev > 4000 THEN 1.0 ELSE 0.2 END AS share, land.elev FROM k JOIN top USING (mode, id) JOIN ids USING (mode, root) LEFT JOIN land USING (lat, lon)),
t AS (SELECT mode, event_id, min(ts) AS start_time, avg(intensity) AS mean_intensity, CAST(max(intensity) AS DOUBLE) AS max_intensity, date_diff('second', min(ts), max(ts)) / 3600.0 + 6 AS duration_hours,
  avg(ivt) AS ivt, avg(pv_250) AS pv_250 FROM v GROUP BY mode, event_id HAVING count(*) >= 2),
c AS (SELECT DISTINCT mode, event_id, lat, lon, share, elev FROM v),
a AS (SELECT mode, event_id, sum({DLAT} * 111.0 * {DLON} * 111.0 * cos(radians(lat))) AS footprint_area_km2, avg(lat) FILTER (share > 0.5) AS landfall_lat, avg(elev) AS mean_elev_m, max(elev) AS max_elev_m, stddev_pop(elev) AS std_elev_m,
  avg(CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END) FILTER (elev IS NOT NULL) AS land_fraction FROM c GROUP BY mode, event_id),
l AS (SELECT mode, event_id, avg(CAST(lat_deg AS DOUBLE)) AS lat_deg FROM (SELECT DISTINCT mode, event_id, lat AS lat_deg FROM v) GROUP BY mode, event_id),
w AS (SELECT mode, event_id, sin({_TAU!r} * (dayofyear(make_timestamp(CAST(floor(avg(epoch_us(ts))) AS BIGINT))) - 1)) AS doy_sin FROM (SELECT DISTINCT mode, event_id, ts FROM v) GROUP BY mode, event_id),
e AS (SELECT mode, event_id, start_time, ivt, pv_250, lat_deg, doy_sin, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in scenarios.STAGE2)}, {', '.join(f'{c} AS d_{c}' for c in scenarios.STAGE2)}
  FROM t JOIN a USING (mode, event_id) JOIN l USING (mode, event_id) JOIN w USING (mode, event_id))
SELECT mode, event_id, start_time, {', '.join(f"{r(f'd_{c}')} AS {c}" for c in ('mean_intensity', 'max_intensity', 'footprint_area_km2', 'duration_hours', 'landfall_lat', 'mean_elev_m', 'land_fraction'))},
  {', '.join(f'{r(c)} AS {c}' for c in ('lat_deg', 'doy_sin', 'ivt', 'pv_250'))},
  {', '.join(f'{r(_mean_sql(STAGE2_TREES, RATE2, [STARTS2[q] + f for f in range(FOLDS)]))} AS {name}' for q, name in scenarios.QUANTILES.items())} FROM e"""


# --- attributions -----------------------------------------------------------------

BUCKETS = {"thermodynamic": ["theta_e_850", "ivt"], "dynamic": ["pv_250", "eady_growth_rate", "ivt_u", "ivt_v"], "other": ["lat_deg", "doy_sin", "doy_cos"]}


def q_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of the intensity models, mean size over the folds, as bucket means by band of latitude."""
    matrix = scenarios.stage1_matrix(feature_cells(spark, d))
    found = trees.attributions(matrix.withColumn("band_lat", F.col("lat")), _models(spark).where("model = 'stage1'"), ["it", "iy", "ix", "band_lat"])
    sums = learning.bucket_sums(found, "band_lat", BUCKETS)
    band = right_closed_band("band_lat", [25.0, 35.0, 45.0, 60.0], ["south_25_35N", "central_35_45N", "north_45_60N"])
    return sums.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), *[edge(F.avg(b)).alias(b) for b in BUCKETS])


def _shap_sql(fold: int) -> dict[str, str]:
    """By feature the attribution of a fold: of two features on a path, half of what each adds before and after the other."""
    terms: dict[str, list[str]] = {}
    for a, ca, lo, b, cb, mid, hi, (n0, n1, n2) in STAGE1_TREES:
        lo, mid, hi = lo + fold, mid + fold, hi + fold
        n, under = n0 + n1 + n2, f"CAST({n1} AS DOUBLE) / {n1 + n2} * {mid} + CAST({n2} AS DOUBLE) / {n1 + n2} * ({hi})"
        below = f"(CASE WHEN {_below(b, cb)} THEN {mid} ELSE {hi} END)"
        none = f"(CAST({n0} AS DOUBLE) / {n} * ({lo}) + CAST({n1 + n2} AS DOUBLE) / {n} * ({under}))"
        only_a = f"(CASE WHEN {_below(a, ca)} THEN {lo} ELSE {under} END)"
        only_b = f"(CAST({n0} AS DOUBLE) / {n} * ({lo}) + CAST({n1 + n2} AS DOUBLE) / {n} * {below})"
        both = f"(CASE WHEN {_below(a, ca)} THEN {lo} ELSE {below} END)"
        for f, own, other in ((a, only_a, only_b), (b, only_b, only_a)):
            terms.setdefault(f, []).append(f"{RATE1} * 0.5 * (({own} - {none}) + ({both} - {other}))")
    return {f: " + ".join(t) for f, t in terms.items()}


_PHI = {f: "(" + " + ".join(f"abs({_shap_sql(k).get(f, '0')})" for k in range(FOLDS)) + f") / {FOLDS}" for f in scenarios.STAGE1}


# --- folds ------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lineitem as points of 25-60 N, 210-250 E with a year."""
    return read(spark, d, "lineitem").select(
        (25 + F.col("l_suppkey") * 7 % 349 / F.lit(10.0)).alias("lat"), (210 + F.col("l_partkey") * 11 % 397 / F.lit(10.0)).alias("lon"), F.year("l_shipdate").alias("yr"),
        (F.col("l_quantity") > 45).alias("mask"), "l_quantity", "l_discount", "l_tax",
    ).withColumn("y", F.col("l_quantity") * (1 - F.col("l_discount")) + F.when(F.col("lat") > 40, 8.0).otherwise(0.0))


def q_fold_plan(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by rate, years permuted, a buffer of one degree: what each fold tests, learns from and leaves out of each block."""
    plan = folds.fold_plan(_points(spark, d), "lat", "lon", F.col("yr"), F.col("mask"))
    each = plan.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    test = (F.col("spatial_fold") == F.col("fold")) & (F.col("year_fold") == F.col("fold"))
    apart = (F.col("spatial_fold") != F.col("fold")) & (F.col("year_fold") != F.col("fold"))
    near = F.array_contains("near_folds", F.col("fold"))
    return each.groupBy("fold", "block_lat", "block_lon", "spatial_fold").agg(F.count_if(test).alias("n_test"), F.count_if(apart & ~near).alias("n_train"), F.count_if(apart & near).alias("n_buffer"))


_POINTS = "x AS (SELECT 25 + l_suppkey * 7 % 349 / CAST(10 AS DOUBLE) AS lat, 210 + l_partkey * 11 % 397 / CAST(10 AS DOUBLE) AS lon, CAST(year(l_shipdate) AS INTEGER) AS yr, l_quantity > 45 AS mask, l_quantity FROM lineitem)"
_PLAN = f"""{_POINTS},
p AS (SELECT *, CAST(floor((lat - 25) / 5) AS INTEGER) AS bi, CAST(floor((lon - 210) / 5) AS INTEGER) AS bj FROM x),
b AS (SELECT bi, bj, 25 + (bi + 0.5) * CAST(5 AS DOUBLE) AS blat, 210 + (bj + 0.5) * CAST(5 AS DOUBLE) AS blon, (row_number() OVER (ORDER BY avg(CASE WHEN mask THEN 1.0 ELSE 0.0 END), bi, bj) - 1) % 5 AS sf
  FROM p GROUP BY bi, bj),
yf AS (SELECT yr, (row_number() OVER (ORDER BY md5(yr || ':43'), yr) - 1) % 5 AS yf FROM (SELECT DISTINCT yr FROM x)),
pl AS (SELECT DISTINCT p.lat, p.lon, n.sf AS near FROM p JOIN b AS n ON sqrt(pow(greatest(abs(p.lat - n.blat) - 2.5, 0), 2) + pow(greatest(abs(p.lon - n.blon) - 2.5, 0), 2)) < 1),
pf AS (SELECT p.*, b.blat, b.blon, b.sf, yf.yf, f.fold, EXISTS (SELECT 1 FROM pl WHERE pl.lat = p.lat AND pl.lon = p.lon AND pl.near = f.fold) AS near FROM p
  JOIN b USING (bi, bj) JOIN yf USING (yr), (SELECT unnest(range(5)) AS fold) AS f)"""


def q_cv_report(spark: SparkSession, d: str) -> DataFrame:
    """Means and deviations over the folds of a plain prediction's metrics on what each fold tests."""
    plan = folds.fold_plan(_points(spark, d), "lat", "lon", F.col("yr"), F.col("mask"))
    scored = plan.where(reduce(lambda a, b: a | b, [folds.tested(k) for k in range(5)])).withColumn("pred", 20 + F.col("l_quantity") * 0.5 + F.col("lat") * 0.25)
    metrics = learning.regression_metrics(scored, ["spatial_fold"], "l_quantity", "pred", 45.0)
    out = folds.cv_report(metrics, ["rmse", "r2", "f1"])
    return out.select("n_folds", *[edge(c).alias(c) for c in out.columns if c != "n_folds"])


# --- boosters ---------------------------------------------------------------------

#: Growth of the registered boosters: bounded so that they can be compared with a plain grower.
STAGE1_GROWTH = boosting.Growth(rounds=12, patience=4, leaves=8, rate=0.3, least=50, bins=32, seed=42)
STAGE2_GROWTH = boosting.Growth(rounds=12, patience=4, leaves=6, rate=0.3, least=30, bins=32, seed=42)
STAGE1_COLUMNS, STAGE2_COLUMNS = ["l_quantity", "l_discount", "l_tax", "lat"], ["q", "n", "disc"]


def _tested(counts: DataFrame, models: DataFrame, features: list[str], names: dict[int, dict[tuple, str]], spec: dict[int, int]) -> DataFrame:
    """Counted rows that a fold is scored on (``w`` of them), with the predictions of its own models.

    names: by fold its models' columns; spec: by fold the number of a model that holds out the fold's rows.
    """
    rows = counts.where(reduce(lambda a, b: a | b, [F.col("_held")[m] > 0 for m in spec.values()])).select(*features, "y", *[F.col("_held")[m].alias(f"_w{k}") for k, m in spec.items()])
    scored = trees.score(rows, models, {model: f"_p{k}_{name}" for k, own in names.items() for model, name in own.items()})
    folds_ = [F.struct(F.lit(k).alias("spatial_fold"), F.col(f"_w{k}").alias("w"), *[F.col(f"_p{k}_{name}").alias(name) for name in own.values()]) for k, own in names.items()]
    return scored.select("y", F.inline(F.array(*folds_))).where("w > 0")


def q_ml_stage1(spark: SparkSession, d: str) -> DataFrame:
    """Absolute-error boosters by space-year folds with a buffer, stopped and scored on the rows left out."""
    plan = folds.fold_plan(_points(spark, d), "lat", "lon", F.col("yr"), F.col("mask"), 3)
    specs = [boosting.Spec(k, 0.5, folds.trained(k), folds.tested(k)) for k in range(3)]
    counts = materialize(boosting.counted(plan, STAGE1_COLUMNS, "y", specs), "counts")
    models = materialize(boosting.fit_counted(counts, STAGE1_COLUMNS, "y", specs, STAGE1_GROWTH, "stage1"), "models")
    tested = _tested(counts, models, STAGE1_COLUMNS, {k: {(k, None): "pred"} for k in range(3)}, {k: k for k in range(3)})
    out = learning.regression_metrics(tested, ["spatial_fold"], "y", "pred", 45.0, "w")
    rounds = models.groupBy(F.col("fold").alias("spatial_fold")).agg(F.count(F.lit(1)).alias("n_trees"))
    return out.join(rounds, "spatial_fold")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"), F.avg("l_discount").alias("disc"), F.sum("l_extendedprice").alias("y"))
    return rows.withColumn("lat", 25 + F.col("l_orderkey") * 7 % 349 / F.lit(10.0)).withColumn("lon", F.when(F.col("l_orderkey") % 9 > 0, 210 + F.col("l_orderkey") * 11 % 397 / F.lit(10.0)))


def q_ml_stage2(spark: SparkSession, d: str) -> DataFrame:
    """Three quantile boosters a fold on order-sized rows, folds by landfall block with a buffer; pinball losses and coverage of the rows left out."""
    plan = folds.event_fold_plan(materialize(_orders(spark, d), "orders"), "lat", "lon", 2)
    alphas = {0.05: "q05", 0.5: "q50", 0.95: "q95"}
    rows = [(folds.event_trained(k), F.col("spatial_fold") == k) for k in range(2)]
    specs = [boosting.Spec(k, a, *rows[k], a) for k in range(2) for a in alphas]
    counts = materialize(boosting.counted(plan, STAGE2_COLUMNS, "y", specs), "counts")
    models = materialize(boosting.fit_counted(counts, STAGE2_COLUMNS, "y", specs, STAGE2_GROWTH, "stage2"), "models")
    tested = _tested(counts, models, STAGE2_COLUMNS, {k: {(k, a): n for a, n in alphas.items()} for k in range(2)}, {k: len(alphas) * k for k in range(2)})
    return tested.groupBy("spatial_fold").agg(F.sum("w").alias("n"), *[learning.pinball("y", c, a, "w").alias(f"pinball_{c}") for a, c in alphas.items()], learning.coverage("y", "q05", "q95", "w").alias("pi90_coverage"))


# --- training rows ----------------------------------------------------------------


def q_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Detected cells and three others for each by year, written by year and read again."""
    cells = feature_cells(spark, d)
    cube = cells.drop("yr", "mo")
    limit = cells.groupBy("mo", "iy", "ix").agg(F.avg("ivt").alias("_clim"))
    mask = cells.join(limit, ["mo", "iy", "ix"]).where((F.col("ivt") > 1.25 * F.col("_clim")) & (F.col("ivt") > 250)).select("it", "iy", "ix")
    path = new_folder(spark, "training-rows")
    made = materialize(training.training_rows(cube, mask, ["it", "iy", "ix"]), "training-rows")
    training.build_table(made, path)
    rows = training.read_table(spark, path, made.schema)
    return rows.select("year", "it", "iy", "ix", "ar_mask", edge(F.col("ivt").cast("double"), 3).alias("ivt"), edge(F.col("ar_intensity").cast("double"), 3).alias("ar_intensity"), edge(F.col("doy_sin").cast("double"), 4).alias("doy_sin"))


_F = (q_training_rows, q_score_scenarios, q_stage1_intensity, q_attributions, q_fold_plan, q_cv_report, q_ml_stage1, q_ml_stage2)
QUERIES = {f.__name__: f for f in _F}

_ALL = f"cube AS (SELECT 'all' AS mode, {_STAMPED}, iy, ix, {', '.join(_M9)} FROM cells)"
ORACLE = {
    "q_training_rows": f"""WITH {_CELLS}, c AS (SELECT mo, iy, ix, avg(ivt) AS clim FROM cells GROUP BY ALL),
x AS (SELECT yr, (yr - 1992) * 12 + mo AS it, iy, ix, ivt, mo, ivt > 1.25 * clim AND ivt > 250 AS hit FROM cells JOIN c USING (mo, iy, ix)),
k AS (SELECT *, row_number() OVER (PARTITION BY yr, hit ORDER BY md5(it || '|' || iy || '|' || ix || '|42')) AS k, count(*) FILTER (hit) OVER (PARTITION BY yr) AS p FROM x)
SELECT yr AS year, CAST(it AS INTEGER) AS it, iy, ix, hit AS ar_mask, round(CAST(CAST(ivt AS FLOAT) AS DOUBLE) + 0.000000001, 3) AS ivt, CASE WHEN hit THEN round(CAST(CAST(ivt AS FLOAT) AS DOUBLE) + 0.000000001, 3) ELSE 0 END AS ar_intensity,
  round(CAST(CAST(sin({_TAU!r} * dayofyear(make_timestamp(CAST(yr AS BIGINT), CAST(mo AS BIGINT), 15, 0, 0, 0.0))) AS FLOAT) AS DOUBLE) + 0.000000001, 4) AS doy_sin FROM k WHERE hit OR k <= 3 * p""",
    "q_score_scenarios": SCENARIO_SQL,
    "q_stage1_intensity": f"WITH {_CELLS}, {_ALL}, {_MATRIX} SELECT iy, ix, count(*) AS n, {r('avg(intensity)')} AS mean, CAST(max(intensity) AS DOUBLE) AS most, count(*) FILTER (intensity > {THRESHOLD}) AS n_above FROM i GROUP BY iy, ix",
    "q_attributions": f"""WITH {_CELLS}, {_ALL}, {_MATRIX}, phi AS (SELECT lat AS band_lat, {', '.join(f'{s} AS s_{f}' for f, s in _PHI.items())} FROM m)
SELECT CASE WHEN band_lat BETWEEN 25 AND 35 THEN 'south_25_35N' WHEN band_lat <= 45 THEN 'central_35_45N' WHEN band_lat <= 60 THEN 'north_45_60N' END AS band, count(*) AS n,
  {', '.join(f"{r('avg(' + ' + '.join(f's_{c}' for c in own) + ')')} AS {b}" for b, own in BUCKETS.items())} FROM phi GROUP BY 1""",
    "q_fold_plan": f"""WITH {_PLAN}
SELECT CAST(fold AS INTEGER) AS fold, blat AS block_lat, blon AS block_lon, CAST(sf AS INTEGER) AS spatial_fold, count(*) FILTER (sf = fold AND yf = fold) AS n_test, count(*) FILTER (sf <> fold AND yf <> fold AND NOT near) AS n_train,
  count(*) FILTER (sf <> fold AND yf <> fold AND near) AS n_buffer FROM pf GROUP BY fold, blat, blon, sf""",
    "q_cv_report": f"""WITH {_PLAN}, s AS (SELECT sf, l_quantity AS y, 20 + l_quantity * 0.5 + lat * 0.25 AS pred FROM pf WHERE fold = 0 AND sf = yf),
k AS (SELECT sf, avg((y - pred) * (y - pred)) AS e, var_pop(y) AS v, count(*) FILTER (y > 45 AND pred > 45) AS tp, count(*) FILTER (y <= 45 AND pred > 45) AS fp, count(*) FILTER (y > 45 AND pred <= 45) AS fn
  FROM s GROUP BY sf),
q AS (SELECT sqrt(e) AS rmse, 1 - e / v AS r2, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS q FROM k), g AS (SELECT rmse, r2, 2 * p * q / nullif(p + q, 0) AS f1 FROM q)
SELECT count(*) AS n_folds, {', '.join(f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std" for c in ('rmse', 'r2', 'f1'))} FROM g""",
}
