"""Decompositions, bootstrap, trends, regression and ensembles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import SEASONS, edge, ratio, signed, star
from isobar.operators import decomposition as dec
from isobar.operators import ensemble, grid, trends, windows
from isobar.plans.base import CELLS_SQL, CUBE_SQL, FLAT_SQL, WINDOWS_SQL, YEARLY_SQL, cells, cube, flat, r, read, yearly
from isobar.plans.base import windows as window_table

G = 9.80665
YEARS = list(range(1995, 2002))
REPS, SEED = 40, 7
#: Replicates of the queries that draw as many as the reference.
WHOLE_REPS = 1000


def _pairs(spark: SparkSession, d: str, base: str = "w1", later: str = "w3") -> DataFrame:
    series = yearly(spark, d).withColumnRenamed("yr", "year")
    means = dec.window_means(series, window_table(spark), ["corridor"], ["ivt", "iwv"])
    return dec.pair(means, ["corridor"], ["ivt", "iwv"], base, later)


def q_three_term(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("corridor", *dec.three_term()).select("corridor", *[edge(c).alias(c) for c in ("thermo", "dynamic", "cross", "total")])


def q_two_term(spark: SparkSession, d: str) -> DataFrame:
    out = _pairs(spark, d).select("corridor", *dec.two_term())
    return out.select("corridor", *[edge(c).alias(c) for c in ("thermo", "dynamic", "total")], edge(100 * ratio("dynamic", "total")).alias("dynamic_percent"))


def q_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Each window against the first: change in percent and its moisture-only part."""
    series = yearly(spark, d).withColumnRenamed("yr", "year")
    means = dec.window_means(series, window_table(spark), ["corridor"], ["ivt", "iwv"])
    base = means.where("window = 'w1'").select("corridor", F.col("ivt").alias("i0"), F.col("iwv").alias("w0"))
    both = means.join(base, "corridor")
    return both.select("corridor", F.col("window").alias("win"), edge(100 * (ratio("ivt", "i0") - 1)).alias("ivt_percent"), edge(100 * (ratio("iwv", "w0") - 1)).alias("iwv_percent"))


def _climatology(spark: SparkSession, d: str, y0: int, y1: int) -> DataFrame:
    """Monthly climatology of the levels 100 to 400 with products; fixed level and cell weights."""
    rows = cube(spark, d).where((F.col("p") <= 400) & F.col("yr").between(y0, y1))
    out = rows.groupBy("y", "x", F.col("mo").alias("month"), "p").agg(*[F.avg(c).alias(c) for c in ("q", "u", "v")], F.avg(F.col("q") * F.col("u")).alias("qu"), F.avg(F.col("q") * F.col("v")).alias("qv"))
    return out.select(F.col("y").alias("corridor"), F.col("x").alias("cell"), "month", "p", "q", "u", "v", "qu", "qv", (F.lit(100.0) / G).alias("w"), ((F.col("x") + 1) / 10.0).alias("aw"))


def q_level_terms(spark: SparkSession, d: str) -> DataFrame:
    out = dec.level_terms(_climatology(spark, d, 1995, 1997), _climatology(spark, d, 1998, 2001), ["corridor"])
    return out.select("corridor", *[edge(c).alias(c) for c in ("moist", "wind", "cov", "trans", "base", "total", "dmag")], edge(F.col("moist") + F.col("wind") + F.col("cov") + F.col("trans") - F.col("total")).alias("closure"))


def _monthly_cells(spark: SparkSession, d: str) -> DataFrame:
    """All levels, years and cells by month, with the month's mean products; fixed level and cell weights."""
    rows = cells(spark, d).groupBy("yr", "mo", "y", "x", "p").agg(*[F.avg(c).alias(c) for c in ("q", "u", "v")], *[F.avg(F.col("q") * F.col(c)).alias(f"q{c}") for c in ("u", "v")])
    return rows.select(F.col("y").alias("corridor"), F.col("yr").alias("year"), F.col("mo").alias("month"), F.col("x").alias("cell"), "p", "q", "u", "v", "qu", "qv", (F.lit(100.0) / G).alias("w"), ((F.col("x") + 1) / 10.0).alias("aw"))


def q_level_terms_whole(spark: SparkSession, d: str) -> DataFrame:
    """Level terms over all levels and years; the transients are those of the months' mean products."""
    rows, keys = _monthly_cells(spark, d), ["corridor", "cell", "month", "p", "w", "aw"]
    early, late = (rows.where(F.col("year") <= 1997), rows.where(F.col("year") > 1997))
    mean = lambda x: x.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("q", "u", "v", "qu", "qv")])
    out = dec.level_terms(mean(early), mean(late), ["corridor"])
    return out.select("corridor", *[edge(c).alias(c) for c in ("moist", "wind", "cov", "trans", "base", "total", "dmag")], edge(F.col("moist") + F.col("wind") + F.col("cov") + F.col("trans") - F.col("total")).alias("closure"))


def q_yearly_terms_whole(spark: SparkSession, d: str) -> DataFrame:
    """Yearly terms over all levels and years with both wind components, transients and the projection."""
    out = dec.yearly_contributions(_monthly_cells(spark, d), ["corridor"])
    return out.select("corridor", "year", *[edge(c).alias(c) for c in ("moist", "wind", "cov", "trans", "total", "base")], edge(F.col("moist") + F.col("wind") + F.col("cov") + F.col("trans") - F.col("total")).alias("closure"))


def _yearly_cells(spark: SparkSession, d: str) -> DataFrame:
    """Complete cells: those that every year has in that month and level."""
    rows = cube(spark, d).where("p <= 200 and yr between 1996 and 2000")
    n = F.count(F.lit(1)).over(Window.partitionBy("y", "x", "mo", "p"))
    return rows.withColumn("_n", n).where("_n = 5").select(F.col("y").alias("corridor"), F.col("yr").alias("year"), F.col("mo").alias("month"), F.col("x").alias("cell"), "p", "q", "u", (F.lit(100.0) / G).alias("w"), ((F.col("x") + 1) / 10.0).alias("aw"))


def q_yearly_terms(spark: SparkSession, d: str) -> DataFrame:
    out = dec.yearly_terms(_yearly_cells(spark, d), ["corridor"])
    return out.select("corridor", "year", *[edge(c).alias(c) for c in ("moist", "wind", "cov", "total")], edge(F.col("moist") + F.col("wind") + F.col("cov") - F.col("total")).alias("closure"))


def q_sensitivity_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = dec.sensitivity_pairs(spark, 1995, 2001, range(1, 6), (0, 1, 2))
    s = yearly(spark, d)
    both = s.join(F.broadcast(pairs), F.col("yr").between(F.col("a0"), F.col("b1")))
    mean = lambda c, a, b: F.avg(F.when(F.col("yr").between(F.col(a), F.col(b)), F.col(c)))
    out = both.groupBy("corridor", "length", "shift").agg(*[mean(c, a, b).alias(f"{c}{i}") for c in ("ivt", "iwv") for i, (a, b) in enumerate((("a0", "a1"), ("b0", "b1")))])
    return out.select("corridor", "length", "shift", *dec.two_term()).select("corridor", "length", "shift", edge("thermo").alias("thermo"), edge("dynamic").alias("dynamic"))


def q_box_perturbation(spark: SparkSession, d: str) -> DataFrame:
    from isobar.plans.base import regions

    boxes = dec.perturbed_boxes(regions(spark), 1.0)
    places = flat(spark, d).groupBy("yr", "y", "x").agg(F.avg("val").alias("ivt"), F.avg("u").alias("iwv"))
    inside = grid.box_join(places, boxes, "y", "x")
    late = F.col("yr") >= 1999
    mean = lambda c, t: F.avg(F.when(t, F.col(c)))
    out = inside.groupBy("region", "variant").agg(*[mean(c, t).alias(f"{c}{i}") for c in ("ivt", "iwv") for i, t in ((0, ~late), (1, late))])
    return out.select("region", "variant", *dec.two_term()).select("region", "variant", edge("thermo").alias("thermo"), edge("dynamic").alias("dynamic"))


def _draws(block: int, circular: bool, reps: int = REPS) -> np.ndarray:
    return dec.block_draws(len(YEARS), reps, block, SEED, circular)


def _bootstrap(spark: SparkSession, d: str, block: int, circular: bool, reps: int = REPS) -> DataFrame:
    rows = yearly(spark, d).withColumn("pos", F.col("yr") - YEARS[0])
    rows = rows.withColumn("a", F.col("ivt") - F.avg("ivt").over(Window.partitionBy("corridor")))
    found = dec.bootstrap_means(rows, dec.draw_counts(spark, _draws(block, circular, reps)), ["corridor"], "pos", "a")
    # Replicates that draw every year once have mean zero up to float noise; rounding makes that zero.
    found = found.withColumn("mean", edge("mean"))
    out = dec.interval(found, ["corridor"], "mean")
    return out.select("corridor", *[edge(c).alias(c) for c in ("ci_lo", "median", "ci_hi", "p")])


def q_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 1, False)


def q_block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 3, False)


def q_circular_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 2, True)


def q_bootstrap_mean_whole(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 1, False, WHOLE_REPS)


def q_block_bootstrap_whole(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 3, False, WHOLE_REPS)


def q_circular_bootstrap_whole(spark: SparkSession, d: str) -> DataFrame:
    return _bootstrap(spark, d, 2, True, WHOLE_REPS)


def q_level_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Replicates of all level terms between two sets of years, with intervals and p adjusted over corridors."""
    early, late = YEARS[:3], YEARS[3:]
    draws = dec.window_draws([len(early), len(late)], WHOLE_REPS, 2, 11)
    reps = dec.level_term_bootstrap(_monthly_cells(spark, d), ["corridor"], (early, late), draws)
    out = windows.benjamini_hochberg(dec.interval(reps, ["corridor", "term"], "value"), "p", ["term"])
    return out.select("corridor", "term", *[edge(c).alias(c) for c in ("ci_lo", "ci_hi", "p", "pfdr")])


def _warm_cells(spark: SparkSession, d: str) -> DataFrame:
    """As ``_monthly_cells``, with a temperature."""
    warm = cells(spark, d).groupBy(F.col("yr").alias("year"), F.col("mo").alias("month"), F.col("y").alias("corridor"), F.col("x").alias("cell"), "p")
    rows = warm.agg(*[F.avg(c).alias(c) for c in ("q", "u", "v")], *[F.avg(F.col("q") * F.col(c)).alias(f"q{c}") for c in ("u", "v")], F.avg(240 + F.col("val") / 2000).alias("t"))
    return rows.withColumn("w", F.lit(100.0) / G).withColumn("aw", (F.col("cell") + 1) / 10.0)


def _pair_draws(block: int, seed: int) -> list[np.ndarray]:
    return dec.window_draws([3, 4], WHOLE_REPS, block, seed)


def q_window_summary(spark: SparkSession, d: str) -> DataFrame:
    """Level terms with intervals, p and adjusted p by corridor, for the year and each season."""
    seasons = spark.createDataFrame([(s, m) for s, months in SEASONS.items() for m in months], "season string, month int")
    out = dec.window_summary(_warm_cells(spark, d), ["corridor"], (YEARS[:3], YEARS[3:]), _pair_draws(2, 11), ["season"], seasons)
    return out.select("corridor", "season", "term", *[edge(c).alias(c) for c in ("point", "ci_lo", "ci_hi", "p", "pfdr")])


def q_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Three-term split between two sets of years with intervals and the dynamic term's robustness."""
    reps = dec.speed_bootstrap(yearly(spark, d).withColumnRenamed("yr", "year"), ["corridor"], (YEARS[:3], YEARS[3:]), _pair_draws(1, 42))
    out = dec.pair_summary(reps, ["corridor"])
    flags = ("robust", "robust90")
    return out.select("corridor", *[edge(c).alias(c) for c in out.columns if c not in ("corridor", *flags)], *flags)


def q_mean_speed(spark: SparkSession, d: str) -> DataFrame:
    """The cross-check of the level terms: transport as moisture times the speed that is their ratio."""
    rows, keys = _monthly_cells(spark, d), ["corridor", "cell", "month", "p", "w", "aw"]
    mean = lambda x: x.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("q", "u", "v", "qu", "qv")])
    terms = dec.level_terms(mean(rows.where(F.col("year") <= 1997)), mean(rows.where(F.col("year") > 1997)), ["corridor"])
    return dec.mean_speed_terms(terms, ["corridor"]).select("corridor", *[edge(c).alias(c) for c in ("thermo", "dynamic", "cross", "total", "base")])


def q_two_sided_p(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.anomaly(flat(spark, d), ["mo"], "val")
    return rows.groupBy("y", "mo").agg(edge(dec.two_sided_p("anom")).alias("p"))


def q_bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("p"))
    p = p.withColumn("g", F.col("l_suppkey") % 4).withColumn("p", F.round("p", 3))
    return windows.benjamini_hochberg(p, "p", ["g"]).select("l_suppkey", "p", edge("pfdr").alias("pfdr"))


def _supplier_years(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k"), F.year("l_shipdate").alias("yr")).agg(F.avg("l_extendedprice").alias("v"))


def q_theil_sen(spark: SparkSession, d: str) -> DataFrame:
    out = trends.theil_sen(_supplier_years(spark, d), ["k"], "yr", "v")
    return out.select("k", edge("slope").alias("slope"), edge("intercept", 4).alias("intercept"))


def q_mann_kendall(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("k"), F.year("l_shipdate").alias("yr")).agg(F.max("l_quantity").alias("v"))
    out = trends.mann_kendall(rows, ["k"], "yr", "v")
    return out.select("k", *[edge(c).alias(c) for c in ("n", "s", "var_s", "tau", "z")])


def q_hamed_rao(spark: SparkSession, d: str) -> DataFrame:
    rows = flat(spark, d).groupBy("y", "x", (F.col("yr") * 12 + F.col("mo")).alias("m")).agg(F.avg("val").alias("v"))
    out = trends.trend_table(rows, ["y", "x"], "m", "v", 120.0)
    return out.select("y", "x", "n", *[edge(c).alias(c) for c in ("slope", "tau", "z", "p", "p_plain", "n_eff_ratio")])


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("y", ((F.col("yr") - 1995) * 12 + F.col("mo")).alias("m")).agg(F.avg("val").alias("v"), F.avg("q").alias("q"), F.avg("u").alias("u"))


def q_running_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = _monthly(spark, d)
    return rows.select("y", "m", edge(windows.running_mean("v", "m", 7, 4, ["y"])).alias("loose"), edge(windows.running_mean("v", "m", 9, None, ["y"])).alias("strict"))


def q_emergence(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_years(spark, d)
    out = windows.emergence(rows, ["k"], "yr", "v", (1995, 1997))
    return out.select("k", edge("slope").alias("slope"), "emerges")


def q_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _monthly(spark, d).select("y", "m", edge(windows.zscore("v", ["y"])).alias("z"))


def q_rank_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return rows.select("p_partkey", edge(windows.average_rank("p_size", ["p_brand"])).alias("rank"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as members of nations' models; terms by return flag."""
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("model"))
    li = read(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("term")).agg((F.avg("l_extendedprice") - 38000).alias("value"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("model", F.col("l_suppkey").alias("member"), "term", "value")


def q_ensemble_stats(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    obs = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("term")).agg((F.percentile("l_extendedprice", F.lit(0.51)) - 38000).alias("obs"))
    out = ensemble.ensemble_stats(m, obs, ["model", "term"], least=5)
    return out.select("model", "term", "n", *[edge(c).alias(c) for c in ("mean", "sd", "obs", "extreme", "low", "high", "z")])


def q_weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    m = ensemble.model_weights(_members(spark, d), "model", ["term"])
    parts = [ensemble.weighted_quantile(m, ["term"], "value", "w", q).select("term", edge("quantile").alias(f"q{int(100 * q)}")) for q in (0.05, 0.5, 0.95)]
    return parts[0].join(parts[1], "term").join(parts[2], "term")


def q_ensemble_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = ensemble.ensemble_quantiles(_members(spark, d), ["term"], "value")
    return out.select("term", "n", *[edge(c).alias(c) for c in ("q25", "median", "q75", "low", "high")])


def q_common_mode(spark: SparkSession, d: str) -> DataFrame:
    """Yearly values over the year's common factor (all corridors' mean over its own mean)."""
    s = yearly(spark, d)
    year = s.groupBy("yr").agg(F.avg("ivt").alias("c"))
    whole = year.agg(F.avg("c").alias("m"))
    factor = year.crossJoin(F.broadcast(whole)).select("yr", (F.col("c") / F.col("m")).alias("f"))
    return s.join(F.broadcast(factor), "yr").select("corridor", "yr", edge(ratio("ivt", "f")).alias("ivt"))


def q_efficiency_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Ratio fields above a floor (the 20 % quantile of the environment), land against ocean.

    GO if the ratio differs between land and ocean over twice as much as the environment does.
    """
    places = flat(spark, d).groupBy("y", "x").agg(F.avg("val").alias("f"), F.avg("u").alias("c"))
    floor = F.broadcast(places.agg(F.percentile("c", F.lit(0.2)).alias("floor")))
    eff = F.when(F.col("c") > F.col("floor"), ratio("f", "c"))
    land = (F.col("y") + F.col("x")) % 2 == 0
    side = lambda x, name: [F.avg(F.when(land, x)).alias(f"{name}land"), F.avg(F.when(~land, x)).alias(f"{name}ocean")]
    out = places.crossJoin(floor).groupBy("y").agg(*side(eff, ""), *side(F.col("c"), "c_"))
    contrast = ratio("land", "ocean")
    decoupling = F.try_divide(contrast, ratio("c_land", "c_ocean"))
    return out.select("y", edge("land").alias("land"), edge("ocean").alias("ocean"), edge(contrast).alias("contrast"), edge(decoupling).alias("decoupling"), F.when(decoupling > 2, "GO").otherwise("INCONCLUSIVE").alias("verdict"))


def q_corr_indices(spark: SparkSession, d: str) -> DataFrame:
    """Two box indices by month, anomalies by calendar month, and their correlation."""
    rows = flat(spark, d)
    box = lambda lo, hi, c: F.avg(F.when(F.col("y").between(lo, hi), F.col(c)))
    idx = rows.groupBy("yr", "mo").agg((box(0, 1, "val") - box(3, 4, "val")).alias("a"), box(0, 4, "u").alias("b"))
    w = Window.partitionBy("mo")
    anom = idx.select("yr", "mo", *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in ("a", "b")])
    return anom.groupBy("mo").agg(edge(F.corr("a", "b")).alias("r"), F.count(F.lit(1)).alias("n"))


def q_ols_ar1(spark: SparkSession, d: str) -> DataFrame:
    out = trends.regression_table(_monthly(spark, d), ["y"], "m", "v", ["q", "u"])
    return out.select("y", "label", *[edge(c).alias(c) for c in ("coef", "se", "p", "r2", "n_eff")])


def q_detrend(spark: SparkSession, d: str) -> DataFrame:
    rows = _monthly(spark, d)
    w = Window.partitionBy("y")
    slope, icept = F.regr_slope("v", "m").over(w), F.regr_intercept("v", "m").over(w)
    return rows.select("y", "m", edge(F.col("v") - slope * F.col("m") - icept).alias("residual"))


def q_welch_t(spark: SparkSession, d: str) -> DataFrame:
    rows = flat(spark, d).withColumn("w", F.when(F.col("yr") <= 1997, "early").when(F.col("yr") >= 1999, "late"))
    out = trends.welch(rows.where("w is not null"), ["y", "x"], "w", "val", "early", "late")
    return out.select("y", "x", *[edge(c).alias(c) for c in ("difference", "t", "df")])


def q_eof(spark: SparkSession, d: str) -> DataFrame:
    out = trends.eof_table(spark, read(spark, d, "embeddings"), "embedding", 64, 8)
    return out.select("mode", edge("share").alias("share"))


def q_kde(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "part").select(F.col("p_retailprice").alias("x"))
    at = spark.range(10).select((900.0 + 20.0 * F.col("id")).alias("place"))
    return trends.kde(points, at, "x", 0.3, "place").select("place", edge("density").alias("density"))


def q_block_cv(spark: SparkSession, d: str) -> DataFrame:
    return trends.contiguous_cv_r2(_monthly(spark, d), ["y"], "m", "v", 5).select("y", edge("r2").alias("r2"))


def q_term_table(spark: SparkSession, d: str) -> DataFrame:
    """The three terms as text, in the fixed order of corridors, with a mark of size."""
    t = _pairs(spark, d).select("corridor", *dec.three_term())
    order = spark.createDataFrame([(i, (3 * i + 1) % 6) for i in range(6)], "ordinal int, corridor int")
    row = F.concat_ws(" & ", F.format_string("c%d", F.col("corridor")), *[F.concat(signed(c), star(F.abs(c) / 10000, 0.01)) for c in ("thermo", "dynamic", "cross")])
    return order.join(t, "corridor", "left").select("ordinal", F.when(F.col("total").isNotNull(), row).alias("line"))


_F = (q_three_term, q_two_term, q_evolution, q_level_terms, q_yearly_terms, q_level_terms_whole, q_yearly_terms_whole, q_sensitivity_matrix, q_box_perturbation, q_bootstrap_mean, q_block_bootstrap, q_circular_bootstrap, q_bootstrap_mean_whole, q_block_bootstrap_whole, q_circular_bootstrap_whole, q_level_bootstrap, q_window_summary, q_pair_summary, q_mean_speed, q_two_sided_p, q_bh_fdr, q_theil_sen, q_mann_kendall, q_hamed_rao, q_running_mean, q_emergence, q_zscore, q_rank_avg, q_ensemble_stats, q_weighted_quantile, q_ensemble_quantiles, q_common_mode, q_efficiency_contrast, q_corr_indices, q_ols_ar1, q_detrend, q_welch_t, q_eof, q_kde, q_block_cv, q_term_table)
QUERIES = {f.__name__: f for f in _F}

_MEANS = f"{YEARLY_SQL}, {WINDOWS_SQL}, means AS (SELECT corridor, win, avg(ivt) AS ivt, avg(iwv) AS iwv FROM yearly JOIN windows ON yr BETWEEN y0 AND y1 GROUP BY corridor, win)"
_PAIR = f"{_MEANS}, pr AS (SELECT a.corridor, a.ivt AS i0, a.iwv AS w0, b.ivt AS i1, b.iwv AS w1 FROM means a JOIN means b USING (corridor) WHERE a.win = 'w1' AND b.win = 'w3')"
_CLIM = "SELECT y, x, mo, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(q * u) AS qu, avg(q * v) AS qv FROM cube WHERE p <= 400 AND yr BETWEEN {0} AND {1} GROUP BY y, x, mo, p"
_W = f"100.0 / {G}"
_YC = """rows5 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY y, x, mo, p) AS n FROM cube WHERE p <= 200 AND yr BETWEEN 1996 AND 2000) WHERE n = 5)"""
_MC = f"mc AS (SELECT yr, mo, y, x, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(q * u) AS qu, avg(q * v) AS qv FROM ({CELLS_SQL}) GROUP BY ALL)"
_MCLIM = "SELECT y, x, mo, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(qu) AS qu, avg(qv) AS qv FROM mc WHERE {0} GROUP BY ALL"
_SY = "sy AS (SELECT l_suppkey % 50 AS k, year(l_shipdate) AS yr, {0} AS v FROM lineitem GROUP BY 1, 2)"
_MON = f"mon AS (SELECT y, (yr - 1995) * 12 + mo AS m, avg(val) AS v, avg(q) AS q, avg(u) AS u FROM ({CELLS_SQL}) GROUP BY ALL)"
_MEM = "mem AS (SELECT s_nationkey AS model, l_suppkey AS member, l_returnflag AS term, avg(l_extendedprice) - 38000 AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
#: Moves of the four edges (lat0, lat1, lon0, lon1) in steps, and a scale about the centre.
_DIRS = [(0, 0, 0, 0, 1.0), *[(*m, 1.0) for k in (-1, 1) for m in ((0, 0, k, 0), (0, 0, 0, k), (k, 0, 0, 0), (0, k, 0, 0), (0, 0, k, k), (k, k, 0, 0))], (0, 0, 0, 0, 0.7), (0, 0, 0, 0, 1.4)]


def _draw_values(block: int, circular: bool, reps: int = REPS) -> str:
    out = []
    for rep, w in enumerate(_draws(block, circular, reps)):
        pos, times = np.unique(w[0], return_counts=True)
        out += [f"({rep}, {p}, {t})" for p, t in zip(pos, times, strict=True)]
    return "dr(rep, pos, times) AS (VALUES " + ", ".join(out) + ")"


def _boot_sql(block: int, circular: bool, reps: int = REPS) -> str:
    return f"""WITH {YEARLY_SQL}, {_draw_values(block, circular, reps)}, a AS (SELECT corridor, yr - 1995 AS pos, ivt - avg(ivt) OVER (PARTITION BY corridor) AS a FROM yearly),
m AS (SELECT corridor, rep, {r('sum(a * times) / sum(times)')} AS m FROM a JOIN dr USING (pos) GROUP BY corridor, rep)
SELECT corridor, {r('quantile_cont(m, 0.025)')} AS ci_lo, {r('quantile_cont(m, 0.5)')} AS median, {r('quantile_cont(m, 0.975)')} AS ci_hi,
{r('least(1.0, 2 * CASE WHEN avg(m) >= 0 THEN avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN m >= 0 THEN 1.0 ELSE 0.0 END) END)')} AS p FROM m GROUP BY corridor"""


def _pair_values(block: int, seed: int) -> str:
    """(rep, win, yr, times); replicate 0 draws each year once."""
    out = []
    for w, (years, draws) in enumerate(zip((YEARS[:3], YEARS[3:]), _pair_draws(block, seed), strict=True)):
        for rep, at in enumerate([np.arange(len(years)), *draws]):
            pos, times = np.unique(at, return_counts=True)
            out += [f"({rep}, {w}, {years[p]}, {t})" for p, t in zip(pos, times, strict=True)]
    return "dr(rep, win, yr, times) AS (VALUES " + ", ".join(out) + ")"


def _drawn(win: int) -> str:
    means = ", ".join(f"sum(times * {c}) / sum(times) AS {c}" for c in ("q", "u", "v", "qu", "qv", "t"))
    return f"SELECT rep, y, x, mo, p, {means} FROM mt JOIN dr USING (yr) WHERE win = {win} GROUP BY ALL"


_ES = "exp(17.67 * ({0} - 273.15) / ({0} - 29.65))"
_LEVEL_PARTS = [(n, e.format(c=c)) for c in "uv" for n, e in ((f"base_{c}", "a.q{c}"), (f"later_{c}", "b.q{c}"), (f"moist_{c}", "a.{c} * (b.q - a.q)"), (f"wind_{c}", "a.q * (b.{c} - a.{c})"), (f"cov_{c}", "(b.q - a.q) * (b.{c} - a.{c})"), (f"trans_{c}", "((b.q{c} - a.q{c}) - (b.q * b.{c} - a.q * a.{c}))"))]
_CC_PARTS = [(f"cc_{c}", f"a.{c} * a.q * ({_ES.format('b.t')} / {_ES.format('a.t')} - 1)") for c in "uv"]
_SUMMARY_TERMS = {"moist": "moist", "wind": "wind", "cov": "cov", "trans": "trans", "total": "later - base", "base": "base", "dmag": "dmag", "moist_cc": "cc", "moist_rh": "moist - cc"}
_BEYOND = "CASE WHEN max(v) FILTER (rep = 0) >= 0 THEN avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) FILTER (rep > 0) ELSE avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END) FILTER (rep > 0) END"
_WINDOW_SUMMARY = f"""WITH mt AS (SELECT yr, mo, y, x, p, avg(q) AS q, avg(u) AS u, avg(v) AS v, avg(q * u) AS qu, avg(q * v) AS qv, avg(240 + val / 2000) AS t FROM ({CELLS_SQL}) GROUP BY ALL), {_pair_values(2, 11)},
s(season, mo) AS (VALUES {', '.join(f"('{s}', {m})" for s, months in SEASONS.items() for m in months)}),
nm AS (SELECT y, season, count(*) AS nm FROM (SELECT DISTINCT y, mo FROM mt) JOIN s USING (mo) GROUP BY ALL),
a AS ({_drawn(0)}), b AS ({_drawn(1)}),
c AS (SELECT a.rep, a.y, a.x, a.mo, {', '.join(f'sum({_W} * {e}) AS {n}' for n, e in _LEVEL_PARTS + _CC_PARTS)} FROM a JOIN b USING (rep, y, x, mo, p) GROUP BY a.rep, a.y, a.x, a.mo),
e AS (SELECT *, sqrt(base_u * base_u + base_v * base_v) AS s, (x + 1) / 10.0 AS aw FROM c),
m AS (SELECT rep, y, mo, {', '.join(f'sum(CASE WHEN s > 0 THEN aw * ({t}_u * base_u + {t}_v * base_v) / s ELSE 0 END) AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'later', 'cc'))}, sum(aw * (sqrt(later_u * later_u + later_v * later_v) - s)) AS dmag
  FROM e GROUP BY rep, y, mo),
g AS (SELECT rep, y, season, {', '.join(f'sum({t}) / any_value(nm) AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'later', 'cc', 'dmag'))} FROM m
  JOIN s USING (mo) JOIN nm USING (y, season) GROUP BY rep, y, season),
l AS ({' UNION ALL '.join(f"SELECT rep, y, season, '{n}' AS term, {e} AS v FROM g" for n, e in _SUMMARY_TERMS.items())}),
q AS (SELECT y, season, term, max(v) FILTER (rep = 0) AS point, quantile_cont(v, 0.025) FILTER (rep > 0) AS lo, quantile_cont(v, 0.975) FILTER (rep > 0) AS hi, least(1.0, 2 * {_BEYOND}) AS p
  FROM l GROUP BY y, season, term),
k AS (SELECT *, p * count(*) OVER (PARTITION BY season, term) / row_number() OVER (PARTITION BY season, term ORDER BY p) AS raw FROM q)
SELECT y AS corridor, season, term, {r('point')} AS point, {r('lo')} AS ci_lo, {r('hi')} AS ci_hi, {r('p')} AS p, {r('least(1.0, min(raw) OVER (PARTITION BY season, term ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS pfdr
  FROM k"""
_PAIR_SUMMARY = f"""WITH {YEARLY_SQL}, {_pair_values(1, 42)},
m AS (SELECT corridor, rep, {', '.join(f'sum({c} * times) FILTER (win = {w}) / sum(times) FILTER (win = {w}) AS {n}{w}' for c, n in (('ivt', 'i'), ('iwv', 'w')) for w in (0, 1))}
  FROM yearly JOIN dr USING (yr) GROUP BY corridor, rep),
t AS (SELECT corridor, rep, i0 / w0 * (w1 - w0) AS thermo, w0 * (i1 / w1 - i0 / w0) AS dynamic, (w1 - w0) * (i1 / w1 - i0 / w0) AS crs, i1 - i0 AS total, i0 AS base, w0 * (i1 / w1 - i0 / w0) AS v FROM m),
q AS (SELECT corridor, {', '.join(f'max({t}) FILTER (rep = 0) AS {t}' for t in ('thermo', 'dynamic', 'crs', 'total', 'base'))},
{', '.join(f'quantile_cont({t}, {x}) FILTER (rep > 0) AS {t}_{n}' for t in ('thermo', 'dynamic', 'crs') for x, n in ((0.05, 'lo90'), (0.95, 'hi90')))}, quantile_cont(dynamic, 0.025) FILTER (rep > 0) AS lo95, quantile_cont(dynamic, 0.975) FILTER (rep > 0) AS hi95, {_BEYOND} AS p
  FROM t GROUP BY corridor),
k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM q), f AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS pf FROM k)
SELECT corridor, {', '.join(f'{r(a)} AS {b}' for a, b in (('thermo', 'thermo'), ('dynamic', 'dynamic'), ('crs', '"cross"'), ('total', 'total'), ('base', 'base'), ('100 * total / base', 'percent'), *((f'{t}_{n}90', f'{o}_{n}90') for t, o in (('thermo', 'thermo'), ('dynamic', 'dynamic'), ('crs', 'cross')) for n in ('lo', 'hi')), ('lo95', 'dynamic_lo95'), ('hi95', 'dynamic_hi95'), ('p', 'p'), ('pf', 'pfdr')))}, pf < 0.05 AS robust, pf < 0.1 AS robust90
  FROM f"""
_MEAN_SPEED = f"""WITH {_MC}, a AS ({_MCLIM.format('yr <= 1997')}), b AS ({_MCLIM.format('yr > 1997')}),
c AS (SELECT a.y, a.x, a.mo, (a.x + 1) / 10.0 AS aw, {', '.join(f'sum({_W} * {t}.{f}) AS {f}{i}' for i, t in enumerate('ab') for f in ('q', 'qu', 'qv'))} FROM a JOIN b USING (y, x, mo, p) GROUP BY a.y, a.x, a.mo),
m AS (SELECT y, mo, {', '.join(f'sum(aw * sqrt(qu{i} * qu{i} + qv{i} * qv{i})) AS i{i}, sum(aw * q{i}) AS w{i}' for i in (0, 1))} FROM c GROUP BY y, mo),
n AS (SELECT y, {', '.join(f'avg({c}{i}) AS {c}{i}' for c in 'iw' for i in (0, 1))} FROM m GROUP BY y)
SELECT y AS corridor, {r('i0 / w0 * (w1 - w0)')} AS thermo, {r('w0 * (i1 / w1 - i0 / w0)')} AS dynamic, {r('(w1 - w0) * (i1 / w1 - i0 / w0)')} AS "cross", {r('i1 - i0')} AS total, {r('i0')} AS base FROM n"""

ORACLE = {
    "q_window_summary": _WINDOW_SUMMARY,
    "q_pair_summary": _PAIR_SUMMARY,
    "q_mean_speed": _MEAN_SPEED,
    "q_three_term": f"""WITH {_PAIR} SELECT corridor, {r('i0 / w0 * (w1 - w0)')} AS thermo, {r('w0 * (i1 / w1 - i0 / w0)')} AS dynamic, {r('(w1 - w0) * (i1 / w1 - i0 / w0)')} AS "cross", {r('i1 - i0')} AS total
  FROM pr""",
    "q_two_term": f"WITH {_PAIR} SELECT corridor, {r('i0 * (w1 / w0 - 1)')} AS thermo, {r('i1 - i0 - i0 * (w1 / w0 - 1)')} AS dynamic, {r('i1 - i0')} AS total, {r('100 * (i1 - i0 - i0 * (w1 / w0 - 1)) / (i1 - i0)')} AS dynamic_percent FROM pr",
    "q_evolution": f"WITH {_MEANS} SELECT a.corridor, a.win, {r('100 * (a.ivt / b.ivt - 1)')} AS ivt_percent, {r('100 * (a.iwv / b.iwv - 1)')} AS iwv_percent FROM means a JOIN means b USING (corridor) WHERE b.win = 'w1'",
    "q_level_terms": f"""WITH {CUBE_SQL}, a AS ({_CLIM.format(1995, 1997)}), b AS ({_CLIM.format(1998, 2001)}),
c AS (SELECT a.y, a.x, a.mo, {', '.join(f'sum({_W} * {e}) AS {n}' for c in 'uv' for n, e in ((f'base_{c}', f'a.q{c}'), (f'later_{c}', f'b.q{c}'), (f'moist_{c}', f'a.{c} * (b.q - a.q)'), (f'wind_{c}', f'a.q * (b.{c} - a.{c})'), (f'cov_{c}', f'(b.q - a.q) * (b.{c} - a.{c})'), (f'trans_{c}', f'((b.q{c} - a.q{c}) - (b.q * b.{c} - a.q * a.{c}))')))}
  FROM a JOIN b USING (y, x, mo, p) GROUP BY a.y, a.x, a.mo),
e AS (SELECT *, sqrt(base_u * base_u + base_v * base_v) AS s, (x + 1) / 10.0 AS aw FROM c),
m AS (SELECT y, mo, {', '.join(f'sum(CASE WHEN s > 0 THEN aw * ({t}_u * base_u + {t}_v * base_v) / s ELSE 0 END) AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'later'))}, sum(aw * (sqrt(later_u * later_u + later_v * later_v) - s)) AS dmag
  FROM e GROUP BY y, mo)
SELECT y AS corridor, {', '.join(f'{r(f"avg({t})")} AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'dmag'))}, {r('avg(later) - avg(base)')} AS total, {r('avg(moist) + avg(wind) + avg(cov) + avg(trans) - (avg(later) - avg(base))')} AS closure
  FROM m GROUP BY y""",
    "q_yearly_terms": f"""WITH {CUBE_SQL}, {_YC}, a AS (SELECT *, avg(q) OVER w AS qm, avg(u) OVER w AS um, avg(q * u) OVER w AS qum, {_W} * ((x + 1) / 10.0) AS k FROM rows5 WINDOW w AS (PARTITION BY y, mo, x, p)),
m AS (SELECT y, yr, mo, sum(k * um * (q - qm)) AS moist, sum(k * qm * (u - um)) AS wind, sum(k * ((q - qm) * (u - um) - (qum - qm * um))) AS cov, sum(k * (q * u - qum)) AS total FROM a GROUP BY y, yr, mo)
SELECT y AS corridor, yr AS year, {', '.join(f'{r(f"avg({t})")} AS {t}' for t in ('moist', 'wind', 'cov', 'total'))}, {r('avg(moist) + avg(wind) + avg(cov) - avg(total)')} AS closure FROM m GROUP BY y, yr""",
    "q_level_terms_whole": f"""WITH {_MC}, a AS ({_MCLIM.format('yr <= 1997')}), b AS ({_MCLIM.format('yr > 1997')}),
c AS (SELECT a.y, a.x, a.mo, {', '.join(f'sum({_W} * {e}) AS {n}' for c in 'uv' for n, e in ((f'base_{c}', f'a.q{c}'), (f'later_{c}', f'b.q{c}'), (f'moist_{c}', f'a.{c} * (b.q - a.q)'), (f'wind_{c}', f'a.q * (b.{c} - a.{c})'), (f'cov_{c}', f'(b.q - a.q) * (b.{c} - a.{c})'), (f'trans_{c}', f'((b.q{c} - a.q{c}) - (b.q * b.{c} - a.q * a.{c}))')))}
  FROM a JOIN b USING (y, x, mo, p) GROUP BY a.y, a.x, a.mo),
e AS (SELECT *, sqrt(base_u * base_u + base_v * base_v) AS s, (x + 1) / 10.0 AS aw FROM c),
m AS (SELECT y, mo, {', '.join(f'sum(CASE WHEN s > 0 THEN aw * ({t}_u * base_u + {t}_v * base_v) / s ELSE 0 END) AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'later'))}, sum(aw * (sqrt(later_u * later_u + later_v * later_v) - s)) AS dmag
  FROM e GROUP BY y, mo)
SELECT y AS corridor, {', '.join(f'{r(f"avg({t})")} AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'base', 'dmag'))}, {r('avg(later) - avg(base)')} AS total, {r('avg(moist) + avg(wind) + avg(cov) + avg(trans) - (avg(later) - avg(base))')} AS closure
  FROM m GROUP BY y""",
    "q_yearly_terms_whole": f"""WITH {_MC}, k AS (SELECT y, x, mo, p, avg(q) AS q0, avg(u) AS u0, avg(v) AS v0, avg(qu) AS qu0, avg(qv) AS qv0, avg(q * u) AS su, avg(q * v) AS sv FROM mc GROUP BY ALL),
b AS (SELECT y, x, mo, {_W} * sum(qu0) AS bu, {_W} * sum(qv0) AS bv, sqrt(bu * bu + bv * bv) AS s, (x + 1) / 10.0 AS aw FROM k GROUP BY y, x, mo),
base AS (SELECT y, avg(m) AS base FROM (SELECT y, mo, sum(aw * s) AS m FROM b GROUP BY y, mo) GROUP BY y),
j AS (SELECT mc.*, k.* EXCLUDE (y, x, mo, p), {_W} * aw AS w, CASE WHEN s > 0 THEN bu / s ELSE 0 END AS eu, CASE WHEN s > 0 THEN bv / s ELSE 0 END AS ev FROM mc JOIN k USING (y, x, mo, p) JOIN b USING (y, x, mo)),
m AS (SELECT y, yr, mo, sum(w * (q - q0) * (u0 * eu + v0 * ev)) AS moist, sum(w * q0 * ((u - u0) * eu + (v - v0) * ev)) AS wind,
  sum(w * (((q - q0) * (u - u0) - su + q0 * u0) * eu + ((q - q0) * (v - v0) - sv + q0 * v0) * ev)) AS cov,
  sum(w * ((qu - q * u - qu0 + su) * eu + (qv - q * v - qv0 + sv) * ev)) AS trans, sum(w * ((qu - qu0) * eu + (qv - qv0) * ev)) AS total FROM j GROUP BY y, yr, mo)
SELECT m.y AS corridor, yr AS year, {', '.join(f'{r(f"avg({t})")} AS {t}' for t in ('moist', 'wind', 'cov', 'trans', 'total'))}, {r('any_value(base)')} AS base, {r('avg(moist) + avg(wind) + avg(cov) + avg(trans) - avg(total)')} AS closure
  FROM m JOIN base USING (y) GROUP BY m.y, yr""",
    "q_sensitivity_matrix": f"""WITH {YEARLY_SQL}, g AS (SELECT CAST(l AS INTEGER) AS length, CAST(s AS INTEGER) AS shift, 1995 + s AS a0, 1995 + s + l - 1 AS a1, 2002 - l AS b0, 2001 AS b1
  FROM range(1, 6) t(l), range(0, 3) v(s)),
m AS (SELECT corridor, length, shift, avg(ivt) FILTER (yr BETWEEN a0 AND a1) AS i0, avg(ivt) FILTER (yr BETWEEN b0 AND b1) AS i1, avg(iwv) FILTER (yr BETWEEN a0 AND a1) AS w0, avg(iwv) FILTER (yr BETWEEN b0 AND b1) AS w1
  FROM yearly, g WHERE a1 < b0 GROUP BY ALL)
SELECT corridor, length, shift, {r('i0 * (w1 / w0 - 1)')} AS thermo, {r('i1 - i0 - i0 * (w1 / w0 - 1)')} AS dynamic FROM m""",
    "q_box_perturbation": f"""WITH {FLAT_SQL}, b(region, a0, a1, o0, o1) AS (VALUES ('north', 2, 4, 0, 3), ('south', 0, 2, 1, 2), ('all', 0, 4, 0, 3)), v(variant, ya, yb, xa, xb, g) AS (VALUES {', '.join(f'({i}, {a}, {b}, {c}, {e}, {g}::DOUBLE)' for i, (a, b, c, e, g) in enumerate(_DIRS))}),
pl AS (SELECT yr, y, x, avg(val) AS ivt, avg(u) AS iwv FROM flat GROUP BY yr, y, x),
m AS (SELECT region, CAST(variant AS INTEGER) AS variant, avg(ivt) FILTER (yr < 1999) AS i0, avg(ivt) FILTER (yr >= 1999) AS i1, avg(iwv) FILTER (yr < 1999) AS w0, avg(iwv) FILTER (yr >= 1999) AS w1
  FROM pl, b, v WHERE y BETWEEN (a0 + a1) / 2.0 + (a0 - (a0 + a1) / 2.0) * g + ya AND (a0 + a1) / 2.0 + (a1 - (a0 + a1) / 2.0) * g + yb
    AND x BETWEEN (o0 + o1) / 2.0 + (o0 - (o0 + o1) / 2.0) * g + xa AND (o0 + o1) / 2.0 + (o1 - (o0 + o1) / 2.0) * g + xb GROUP BY region, variant)
SELECT region, variant, {r('i0 * (w1 / w0 - 1)')} AS thermo, {r('i1 - i0 - i0 * (w1 / w0 - 1)')} AS dynamic FROM m""",
    "q_bootstrap_mean": _boot_sql(1, False),
    "q_block_bootstrap": _boot_sql(3, False),
    "q_circular_bootstrap": _boot_sql(2, True),
    "q_bootstrap_mean_whole": _boot_sql(1, False, WHOLE_REPS),
    "q_block_bootstrap_whole": _boot_sql(3, False, WHOLE_REPS),
    "q_circular_bootstrap_whole": _boot_sql(2, True, WHOLE_REPS),
    "q_two_sided_p": f"""WITH {FLAT_SQL}, a AS (SELECT y, mo, val - avg(val) OVER (PARTITION BY mo) AS a FROM flat)
SELECT y, mo, {r('least(1.0, 2 * CASE WHEN avg(a) >= 0 THEN avg(CASE WHEN a <= 0 THEN 1.0 ELSE 0.0 END) ELSE avg(CASE WHEN a >= 0 THEN 1.0 ELSE 0.0 END) END)')} AS p FROM a GROUP BY y, mo""",
    "q_bh_fdr": f"""WITH p AS (SELECT l_suppkey, l_suppkey % 4 AS g, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 3) AS p FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p) AS raw FROM p)
SELECT l_suppkey, p, {r('least(1.0, min(raw) OVER (PARTITION BY g ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS pfdr FROM k""",
    "q_theil_sen": f"""WITH {_SY.format('avg(l_extendedprice)')}, s AS (SELECT a.k, median((b.v - a.v) / (b.yr - a.yr)) AS slope FROM sy a
  JOIN sy b ON a.k = b.k AND a.yr < b.yr GROUP BY a.k), m AS (SELECT k, median(yr) AS mx, median(v) AS mv FROM sy GROUP BY k)
SELECT k, {r('slope')} AS slope, round(mv - slope * mx + 0.000000001, 4) AS intercept FROM s JOIN m USING (k)""",
    "q_mann_kendall": f"""WITH {_SY.format('max(l_quantity)')}, s AS (SELECT a.k, CAST(sum(sign(b.v - a.v)) AS DOUBLE) AS s FROM sy a JOIN sy b ON a.k = b.k AND a.yr < b.yr GROUP BY a.k),
t AS (SELECT k, CAST(sum(t) AS DOUBLE) AS n, CAST(sum(t * (t - 1) * (2 * t + 5)) AS DOUBLE) AS c FROM (SELECT k, v, count(*) AS t FROM sy GROUP BY k, v) GROUP BY k),
z AS (SELECT k, n, s, (n * (n - 1) * (2 * n + 5) - c) / 18 AS w FROM s JOIN t USING (k))
SELECT k, {r('n')} AS n, {r('s')} AS s, {r('w')} AS var_s, {r('s / nullif(n * (n - 1) / 2, 0)')} AS tau, {r('CASE WHEN w > 0 THEN (s - sign(s)) / sqrt(w) ELSE 0 END')} AS z FROM z""",
    "q_running_mean": f"""WITH {_MON} SELECT y, CAST(m AS INTEGER) AS m, {r('CASE WHEN count(v) OVER a >= 4 THEN avg(v) OVER a END')} AS loose, {r('CASE WHEN count(v) OVER b >= 9 THEN avg(v) OVER b END')} AS strict
FROM mon WINDOW a AS (PARTITION BY y ORDER BY m ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (PARTITION BY y ORDER BY m ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
    "q_emergence": f"""WITH {_SY.format('avg(l_extendedprice)')}, t AS (SELECT a.k, median((b.v - a.v) / (b.yr - a.yr)) AS s FROM sy a JOIN sy b ON a.k = b.k AND a.yr < b.yr GROUP BY a.k),
g AS (SELECT k, median(yr) AS mx, median(v) AS mv, avg(v) FILTER (yr BETWEEN 1995 AND 1997) + stddev_pop(v) FILTER (yr BETWEEN 1995 AND 1997) AS l FROM sy
  GROUP BY k), f AS (SELECT k, s, mv - s * mx AS i, l FROM t JOIN g USING (k))
SELECT sy.k, {r('any_value(s)')} AS slope, CAST(min(yr) FILTER (s * yr + i > l) AS INTEGER) AS emerges FROM sy JOIN f USING (k) GROUP BY sy.k""",
    "q_zscore": f"WITH {_MON} SELECT y, CAST(m AS INTEGER) AS m, {r('(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)')} AS z FROM mon WINDOW w AS (PARTITION BY y)",
    "q_rank_avg": f"SELECT p_partkey, {r('rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0')} AS rank FROM part",
    "q_ensemble_stats": f"""WITH {_MEM}, o AS (SELECT l_returnflag AS term, quantile_cont(l_extendedprice, 0.51) - 38000 AS obs FROM lineitem GROUP BY 1)
SELECT model, term, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS sd, {r('any_value(obs)')} AS obs, {r('avg(CASE WHEN (obs >= mu AND value >= obs) OR (obs < mu AND value <= obs) THEN 1.0 ELSE 0.0 END)')} AS extreme,
{r('min(value)')} AS low, {r('max(value)')} AS high, {r('(any_value(obs) - avg(value)) / nullif(stddev_samp(value), 0)')} AS z
  FROM (SELECT *, avg(value) OVER (PARTITION BY model, term) AS mu FROM mem) JOIN o USING (term) GROUP BY model, term HAVING count(*) >= 5""",
    "q_weighted_quantile": f"""WITH {_MEM}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY term, model) AS w
  FROM mem), c AS (SELECT term, value, sum(w) OVER (PARTITION BY term ORDER BY value RANGE UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY term) AS c FROM w)
SELECT term, {', '.join(f'{r(f"min(value) FILTER (c >= {q} - 1e-12)")} AS q{int(100 * q)}' for q in (0.05, 0.5, 0.95))} FROM c GROUP BY term""",
    "q_ensemble_quantiles": f"WITH {_MEM} SELECT term, count(*) AS n, {r('quantile_cont(value, 0.25)')} AS q25, {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q75, {r('min(value)')} AS low, {r('max(value)')} AS high FROM mem GROUP BY term",
    "q_common_mode": f"WITH {YEARLY_SQL}, c AS (SELECT yr, avg(ivt) AS c FROM yearly GROUP BY yr), m AS (SELECT avg(c) AS m FROM c) SELECT corridor, yr, {r('ivt / (c / m)')} AS ivt FROM yearly JOIN c USING (yr), m",
    "q_efficiency_contrast": f"""WITH {FLAT_SQL}, p AS (SELECT y, x, avg(val) AS f, avg(u) AS c FROM flat
  GROUP BY y, x), e AS (SELECT y, (y + x) % 2 = 0 AS land, c, CASE WHEN c > (SELECT quantile_cont(c, 0.2) FROM p) THEN f / c END AS e
  FROM p), s AS (SELECT y, avg(e) FILTER (land) AS land, avg(e) FILTER (NOT land) AS ocean, avg(c) FILTER (land) / avg(c) FILTER (NOT land) AS env FROM e GROUP BY y)
SELECT y, {r('land')} AS land, {r('ocean')} AS ocean, {r('land / ocean')} AS contrast, {r('land / ocean / env')} AS decoupling, CASE WHEN land / ocean / env > 2 THEN 'GO' ELSE 'INCONCLUSIVE' END AS verdict FROM s""",
    "q_corr_indices": f"""WITH {FLAT_SQL}, i AS (SELECT yr, mo, avg(val) FILTER (y BETWEEN 0 AND 1) - avg(val) FILTER (y BETWEEN 3 AND 4) AS a, avg(u) AS b FROM flat
  GROUP BY yr, mo), n AS (SELECT mo, a - avg(a) OVER (PARTITION BY mo) AS a, b - avg(b) OVER (PARTITION BY mo) AS b FROM i)
SELECT mo, {r('corr(a, b)')} AS r, count(*) AS n FROM n GROUP BY mo""",
    "q_detrend": f"WITH {_MON}, f AS (SELECT y, regr_slope(v, m) AS s, regr_intercept(v, m) AS i FROM mon GROUP BY y) SELECT y, CAST(m AS INTEGER) AS m, {r('v - s * m - i')} AS residual FROM mon JOIN f USING (y)",
    "q_welch_t": f"""WITH {FLAT_SQL}, s AS (SELECT y, x, avg(val) FILTER (yr <= 1997) AS m0, var_samp(val) FILTER (yr <= 1997) / count(*) FILTER (yr <= 1997) AS a, count(*) FILTER (yr <= 1997) AS n0, avg(val) FILTER (yr >= 1999) AS m1, var_samp(val) FILTER (yr >= 1999) / count(*) FILTER (yr >= 1999) AS b, count(*) FILTER (yr >= 1999) AS n1
  FROM flat GROUP BY y, x)
SELECT y, x, {r('m1 - m0')} AS difference, {r('(m1 - m0) / sqrt(a + b)')} AS t, {r('(a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))')} AS df FROM s""",
    "q_kde": f"""WITH s AS (SELECT count(*) AS n, stddev_samp(p_retailprice) * 0.3 AS h FROM part), g AS (SELECT CAST(900 + 20 * i AS DOUBLE) AS place FROM range(10) t(i))
SELECT place, {r('sum(exp(-0.5 * ((place - p_retailprice) / h) * ((place - p_retailprice) / h)) / (n * h * sqrt(2 * pi())))')} AS density FROM part, s, g GROUP BY place""",
    "q_block_cv": f"""WITH {_MON}, i AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY y) AS n, avg(v) OVER (PARTITION BY y) AS mean FROM mon),
k AS (SELECT i.*, (SELECT max(f) FROM range(5) t(f) WHERE floor(n * f / 5.0) <= i) AS f FROM i),
c AS (SELECT a.y, a.f, regr_slope(b.v, b.m) AS s, regr_intercept(b.v, b.m) AS c FROM (SELECT DISTINCT y, f FROM k) a JOIN k b ON a.y = b.y AND a.f <> b.f GROUP BY a.y, a.f)
SELECT k.y, {r('1 - sum((v - c - s * m) * (v - c - s * m)) / sum((v - mean) * (v - mean))')} AS r2 FROM k JOIN c ON k.y = c.y AND k.f = c.f GROUP BY k.y""",
    "q_term_table": f"""WITH {_PAIR}, t AS (SELECT corridor, i0 / w0 * (w1 - w0) AS a, w0 * (i1 / w1 - i0 / w0) AS b, (w1 - w0) * (i1 / w1 - i0 / w0) AS c
  FROM pr), o AS (SELECT CAST(i AS INTEGER) AS ordinal, (3 * i + 1) % 6 AS corridor FROM range(6) r(i))
SELECT ordinal, 'c' || corridor || ' & ' || {" || ' & ' || ".join(f"printf('%+.1f', {x}) || CASE WHEN abs({x}) / 10000 < 0.01 THEN '*' ELSE '' END" for x in "abc")} AS line FROM o LEFT JOIN t USING (corridor)""",
}
