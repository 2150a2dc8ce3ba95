import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions.special import incomplete_beta, normal_sf2, student_sf2
from isobar.operators import decomposition as dec
from isobar.operators import ensemble, learning, trends, windows


def test_distribution_functions():
    assert student_sf2(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and normal_sf2(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(1, x) for x in (0.01, 0.04, 0.03, 0.5, 1.0, 0.03)], "g int, p double")
    out = sorted((r.p, round(r.pfdr, 6)) for r in windows.benjamini_hochberg(p, "p", ["g"]).collect())
    assert out == [(0.01, 0.06), (0.03, 0.06), (0.03, 0.06), (0.04, 0.06), (0.5, 0.6), (1.0, 1.0)]


def test_running_means_ranks_islands(spark):
    x = spark.createDataFrame([(1, i, float(i % 3)) for i in range(9)], "g int, i int, v double")
    strict = [r.m for r in x.select("i", windows.running_mean("v", "i", 7, None, ["g"]).alias("m")).orderBy("i").collect()]
    assert strict[:3] == [None] * 3 and strict[3] == pytest.approx(np.mean([i % 3 for i in range(7)]))
    assert sorted({r.k for r in x.select(windows.average_rank("v", ["g"]).alias("k")).collect()}) == [2.0, 5.0, 8.0]
    runs = windows.islands(x, ["g"], "i", F.col("v") > 0)
    assert runs.groupBy("island").count().count() == 3
    folds = [r.f for r in x.select("i", windows.contiguous_folds(["g"], "i", 4).alias("f")).orderBy("i").collect()]
    edges = np.linspace(0, 9, 5).astype(int)
    assert folds == [int(np.searchsorted(edges, i, side="right") - 1) for i in range(9)]


def test_samples_are_exact_and_deterministic(spark):
    rows = spark.range(2000).select("id", (F.col("id") < 100).alias("pos")).repartition(7)
    out = windows.stratified_sample(rows, F.col("pos"), "id", 3)
    assert out.where("pos").count() == 100 and out.where("not pos").count() == 300
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in windows.stratified_sample(rows.repartition(2), F.col("pos"), "id", 3).collect())
    assert windows.stratified_sample(rows.where("not pos"), F.col("pos"), "id", 3).count() == 0


def test_trends(spark):
    line = spark.createDataFrame([(1, t, 3.0 + 0.5 * t) for t in range(30)] + [(2, t, 7.0) for t in range(30)], "k int, t int, y double")
    out = {r.k: r for r in trends.theil_sen(line, ["k"], "t", "y").collect()}
    assert (out[1].slope, out[1].intercept) == (0.5, 3.0)
    mk = {r.k: r for r in trends.trend_table(line, ["k"], "t", "y", 10).collect()}
    assert mk[1].slope == pytest.approx(5) and mk[1].tau == 1 and mk[2].p == 1 and mk[2].z == 0
    sql = {r.k: r for r in trends.mann_kendall(line, ["k"], "t", "y").collect()}
    assert sql[1].tau == 1 and sql[2].var_s == 0
    rng = np.random.default_rng(0)
    noise = np.cumsum(rng.normal(size=80))
    found = trends.modified_mann_kendall(noise)
    assert found["p"] >= found["p_plain"]
    assert trends.kendall_p(np.arange(10.0), np.arange(10.0))[0] == 1


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    t = np.arange(200)
    a, b = rng.normal(size=(2, 200))
    y = 5 + 0.01 * t + 2 * a - b + 0.01 * rng.normal(size=200)
    rows = spark.createDataFrame([(1, int(i), float(p), float(q), float(z)) for i, p, q, z in zip(t, a, b, y, strict=True)], "g int, t int, a double, b double, y double")
    out = {r.label: r for r in trends.regression_table(rows, ["g"], "t", "y", ["a", "b"]).collect()}
    assert out["a"].coef == pytest.approx(2 * a.std(), rel=0.05) and out["b"].coef == pytest.approx(-b.std(), rel=0.05) and out["a"].p < 1e-6
    coef, _ = trends.ridge(np.column_stack([a, b]), 2 * a - b, np.logspace(-2, 3, 20))
    assert coef[:2] == pytest.approx([2, -1], abs=0.05)
    imp = trends.permutation_importance(np.column_stack([a, b * 0]), 2 * a, lambda x: 2 * x[:, 0], 5)
    assert imp[0] > 0.5 and imp[1] == pytest.approx(0)


def test_first_pattern_of_a_rank_one_field(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=6)
    rows = spark.createDataFrame([([float(x) for x in s * v],) for s in rng.normal(size=50)], "e array<double>")
    patterns, shares = trends.eof(rows, "e", 6, 2)
    assert shares[0] == pytest.approx(1) and abs(patterns[0] @ v) == pytest.approx(np.linalg.norm(v))


def test_welch_and_density(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=20), rng.normal(1, 2, size=30)
    rows = spark.createDataFrame([(1, w, float(x)) for w, xs in (("a", a), ("b", b)) for x in xs], "g int, w string, x double")
    r = trends.student_p(trends.welch(rows, ["g"], "w", "x", "a", "b"), "t", "df").first()
    va, vb = a.var(ddof=1) / 20, b.var(ddof=1) / 30
    assert r.t == pytest.approx((b.mean() - a.mean()) / math.sqrt(va + vb)) and 0 < r.p < 1
    d = trends.kde(rows.select("x"), spark.range(200).select((F.col("id") / 10.0 - 10).alias("at")), "x", 0.3).agg(F.sum("density") / 10).first()[0]
    assert d == pytest.approx(1, abs=0.02)


def level_rows(spark, dq=1.0):
    rng = np.random.default_rng(4)
    rows = [("c", m, x, float(p), *map(float, rng.random(3))) for m in (1, 2) for x in (0, 1) for p in (1, 2, 3)]
    base = [(c, m, x, p, q, u, v, q * u, q * v, 1.0, 0.5) for c, m, x, p, q, u, v in rows]
    later = [(c, m, x, p, dq * q, u, v, dq * q * u, dq * q * v, 1.0, 0.5) for c, m, x, p, q, u, v in rows]
    schema = "corridor string, month int, cell int, p double, q double, u double, v double, qu double, qv double, w double, aw double"
    return spark.createDataFrame(base, schema), spark.createDataFrame(later, schema)


def test_level_terms_close(spark):
    r = dec.level_terms(*level_rows(spark, 2.0), ["corridor"]).first()
    assert r.wind == pytest.approx(0) and r["cov"] == pytest.approx(0) and r.trans == pytest.approx(0)
    assert r.moist == pytest.approx(r.total) and r.dmag == pytest.approx(r.base)


def test_three_terms_close(spark):
    means = spark.createDataFrame([("a", 10.0, 12.0, 2.0, 2.2)], "c string, ivt0 double, ivt1 double, iwv0 double, iwv1 double")
    r = means.select(*dec.three_term()).first()
    assert r.thermo + r.dynamic + r["cross"] == pytest.approx(r.total) == pytest.approx(2.0)
    assert means.select(*dec.two_term()).first().thermo == pytest.approx(1.0)


def test_sensitivity_has_twenty_of_twenty_one_pairs(spark):
    assert dec.sensitivity_pairs(spark, 1940, 2024).count() == 20
    assert dec.perturbed_boxes(spark.createDataFrame([("r", 0.0, 1.0, 2.0, 3.0)], "region string, lat0 double, lat1 double, lon0 double, lon1 double")).count() == 15


def test_draws_are_blocks():
    plain, ring = dec.block_draws(10, 50, 3, 1), dec.block_draws(10, 50, 3, 1, circular=True)
    assert plain.max() == 9 and all((np.diff(r[0][:9].reshape(3, 3), axis=1) == 1).all() for r in plain)
    assert any((np.diff(r[0][:9].reshape(3, 3), axis=1) < 0).any() for r in ring)


def test_bootstrap_brackets_the_mean(spark):
    x = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "g int, pos int, v double")
    reps = dec.bootstrap_means(x, dec.draw_counts(spark, dec.block_draws(20, 200, 1, 5)), ["g"], "pos", "v")
    r = dec.interval(reps, ["g"], "mean").first()
    assert r.ci_lo < 9.5 < r.ci_hi and r.p < 0.05


def test_level_bootstrap_of_constant_fields(spark):
    rows = [("c", y, 1, 0, float(p), 2.0 if y < 3 else 4.0, 3.0, 1.0, 1.0) for y in range(6) for p in (1, 2)]
    cells = spark.createDataFrame(rows, "corridor string, year int, month int, cell int, p double, q double, u double, w double, aw double")
    out = dec.level_bootstrap(cells, ["corridor"], ([0, 1, 2], [3, 4, 5]), dec.block_draws(3, 10, 2, 1, windows=2))
    assert {(r.term, round(r.value, 9)) for r in out.collect()} == {("moist", 12.0), ("wind", 0.0), ("cov", 0.0)}


def test_ensembles(spark):
    m = spark.createDataFrame([("m1", i, float(i)) for i in range(6)] + [("m2", 0, 100.0), ("m2", 1, 200.0)], "model string, member int, value double")
    obs = spark.createDataFrame([("m1", 4.0), ("m2", 1.0)], "model string, obs double")
    out = ensemble.ensemble_stats(m, obs, ["model"]).collect()
    assert [r.model for r in out] == ["m1"] and out[0].extreme == pytest.approx(2 / 6)
    w = ensemble.model_weights(m.withColumn("t", F.lit(1)), "model", ["t"])
    assert ensemble.weighted_quantile(w, ["t"], "value", "w", 0.5).first().quantile == 5.0
    members = spark.createDataFrame([("a", "q"), ("a", "u"), ("b", "q")], "m string, v string")
    assert [r.m for r in ensemble.complete_members(members, ["m"], "v", ["q", "u"]).collect()] == ["a"]


def test_folds_and_metrics(spark):
    rows = spark.range(4000).select(F.col("id"), (25.0 + F.col("id") % 140 / 4).alias("lat"), (210.0 + F.col("id") % 37).alias("lon"))
    rows = rows.withColumn("block", learning.block_index("lat", "lon", 25.0, 210.0))
    folds = learning.permuted_folds(rows, "block", F.col("id") % 10 != 0, 5)
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {-1, 0, 1, 2, 3, 4}
    assert folds.where("id % 10 = 0 and fold <> -1").count() == 0
    preds = spark.createDataFrame([(float(y), 4.0, 10.0, 16.0) for y in (0, 5, 10, 15, 20)], "y double, lo double, mid double, hi double")
    r = preds.agg(learning.coverage("y", "lo", "hi").alias("c"), learning.pinball("y", "y", 0.5).alias("p")).first()
    assert (r.c, r.p) == (0.6, 0.0)


def test_whole_terms_read_every_level_and_year(spark, sf):
    from isobar.plans import base, catalogue

    run = catalogue.queries()
    years = {(r.y, r.yr) for r in base.cells(spark, sf).select("y", "yr").distinct().collect()}
    rows = run["q_yearly_terms_whole"](spark, sf).collect()
    assert {(r.corridor, r.year) for r in rows} == years and any(abs(r.trans) > 1e-3 for r in rows)
    assert all(abs(r.closure) < 1e-6 for r in rows)
    plan = run["q_yearly_terms_whole"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" in plan and "Filter" not in plan
    whole, part = ({r.corridor: r.base for r in run[name](spark, sf).collect()} for name in ("q_level_terms_whole", "q_level_terms"))
    assert whole.keys() == part.keys() and all(whole[k] > 1.3 * part[k] for k in part)


def test_yearly_contributions_project_both_components(spark):
    rows = [("c", y, 1, 0, 1.0, q, 3.0, 4.0, 3 * q + e, 4 * q, 1.0, 1.0) for y, q, e in ((0, 1.0, 0.0), (1, 3.0, 0.0))]
    cells = spark.createDataFrame(rows, "corridor string, year int, month int, cell int, p double, q double, u double, v double, qu double, qv double, w double, aw double")
    out = {r.year: r for r in dec.yearly_contributions(cells, ["corridor"]).collect()}
    assert (out[1].moist, out[1].total, out[1].base) == (pytest.approx(5.0), pytest.approx(5.0), pytest.approx(10.0))
    assert out[0].total == pytest.approx(-5.0) and out[1].wind == pytest.approx(0) == out[1].trans


def test_windows_draw_their_own_lengths():
    short, long = dec.window_draws([2, 5], 400, 2, 1)
    assert short.shape == (400, 2) and long.shape == (400, 5)
    assert abs(short.mean() - 0.5) < 1e-9 and long.max() == 4 and (np.diff(long[:, :4].reshape(400, 2, 2), axis=2) == 1).all()


def test_level_bootstrap_has_all_terms_of_level_terms(spark):
    rows = [("c", y, m, x, p, 1.0 + (y * 7 + m + x + p) % 5, 2.0 + (y * 3 + p) % 4, 1.0 + (y + x) % 3, 1.0, 0.5) for y in range(5) for m in (1, 2) for x in (0, 1) for p in (1.0, 2.0)]
    cells = spark.createDataFrame(rows, "corridor string, year int, month int, cell int, p double, q double, u double, v double, w double, aw double")
    cells = cells.withColumns({f"q{c}": F.col("q") * F.col(c) + F.col("year") for c in ("u", "v")})
    mean = lambda x: x.groupBy("corridor", "month", "cell", "p", "w", "aw").agg(*[F.avg(c).alias(c) for c in ("q", "u", "v", "qu", "qv")])
    want = dec.level_terms(mean(cells.where("year < 2")), mean(cells.where("year >= 2")), ["corridor"]).first()
    every = [np.arange(2)[None, :], np.arange(3)[None, :]]
    out = {r.term: r.value for r in dec.level_term_bootstrap(cells, ["corridor"], ([0, 1], [2, 3, 4]), every).collect()}
    assert out == {t: pytest.approx(want[t]) for t in dec.TERMS}


def test_queries_draw_a_thousand_replicates(spark, sf):
    from isobar.plans import catalogue

    out = catalogue.queries()["q_level_bootstrap"](spark, sf).collect()
    assert {r.term for r in out} == set(dec.TERMS)
    for name in ("q_bootstrap_mean_whole", "q_block_bootstrap_whole", "q_circular_bootstrap_whole"):
        assert "(999, " in catalogue.oracle_sql()[name]


def test_emergence_follows_the_theil_sen_line(spark):
    # One wild year moves a least-squares line, not the median of slopes (1): intercept -2000, limit 1 + sqrt(2 / 3).
    rows = spark.createDataFrame([(1, 2000 + i, float(i if i != 6 else 90)) for i in range(8)], "k int, yr int, v double")
    out = windows.emergence(rows, ["k"], "yr", "v", (2000, 2002)).first()
    assert out.slope == pytest.approx(1.0) and out.emerges == 2002


def test_two_sided_p_takes_the_tail_against_the_points_sign(spark):
    reps = spark.createDataFrame([(x,) for x in (-1.0, -2.0, -3.0, 20.0)], "v double")
    assert reps.agg(dec.two_sided_p("v").alias("p")).first().p == 1.0
    assert reps.agg(dec.two_sided_p("v", F.lit(-1.0)).alias("p")).first().p == 0.5


def test_extreme_share_counts_from_the_members_mean(spark):
    m = spark.createDataFrame([("m", float(x)) for x in (1, 2, 3, 4, 10)], "model string, value double")
    share = lambda o: ensemble.ensemble_stats(m, spark.createDataFrame([("m", o)], "model string, obs double"), ["model"]).first().extreme
    assert share(2.0) == pytest.approx(0.4) and share(4.0) == pytest.approx(0.4) and share(3.0) == pytest.approx(0.6)


def test_box_variants(spark):
    box = spark.createDataFrame([("r", 10.0, 20.0, 100.0, 140.0)], "region string, lat0 double, lat1 double, lon0 double, lon1 double")
    out = {r.variant: (r.lat0, r.lat1, r.lon0, r.lon1) for r in dec.perturbed_boxes(box).collect()}
    assert out[0] == (10, 20, 100, 140) and out[1] == (10, 20, 95, 140) and out[4] == (10, 15, 100, 140) and out[12] == (15, 25, 100, 140)
    assert out[13] == pytest.approx((11.5, 18.5, 106, 134)) and out[14] == pytest.approx((8, 22, 92, 148)) and len(set(out.values())) == 15


def test_variance_factor_and_effective_years():
    y = np.cumsum(np.random.default_rng(2).normal(size=30)) * 3 + np.arange(30) * 0.1
    n = len(y)
    out = trends.modified_mann_kendall(y)
    score = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
    var = n * (n - 1) * (2 * n + 5) / 18
    rest = y - np.median([(y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n)]) * np.arange(n)
    rank = np.array([sum(a < b for a in rest) + sum(a <= b for a in rest) - n for b in rest]) / 2
    factor = 1.0
    for k in range(1, n):
        rho = sum(rank[i] * rank[i + k] for i in range(n - k)) / sum(rank**2)
        if abs(rho) > 1.96 / math.sqrt(n):
            factor += 2 / (n * (n - 1) * (n - 2)) * (n - k) * (n - k - 1) * (n - k - 2) * rho
    assert out["n_eff_ratio"] == pytest.approx(max(factor, 1e-6)) and abs(factor - 1) > 0.05
    assert out["z"] == pytest.approx((score - np.sign(score)) / math.sqrt(var * max(factor, 1e-6)))
    x = np.arange(12.0)
    found = trends.ols(x + np.sin(x / 2), np.cos(x)[:, None], x)
    assert found["n_eff"] == pytest.approx(5.0)


def test_index_files_and_complete_columns(spark, tmp_path):
    from isobar.sources import harmonise

    (tmp_path / "m.txt").write_text("1990 1 2 -9.9 4 5 6 7 8 9 10 11 95\n1991 1 2 3\nheader line\n")
    (tmp_path / "t.txt").write_text("1990 1 -0.5\n1990 2 0.7 9.9\n1990 3 1.5\n")
    months = {(r.year, r.month): r.value for r in harmonise.read_month_table(spark, str(tmp_path / "m.txt")).collect()}
    assert len(months) == 10 and (1990, 3) not in months and (1990, 12) not in months
    assert sorted((r.month, r.value) for r in harmonise.read_triples(spark, str(tmp_path / "t.txt")).collect()) == [(1, -0.5), (3, 1.5)]
    # Half of the points are masked everywhere; of the rest one level in five is missing.
    rows = [("a", 2000, iy, ix, p, None if ix >= 2 or p == 4 else 1.0, 1.0) for iy in range(3) for ix in range(4) for p in range(5)]
    cells = spark.createDataFrame(rows, "member string, year int, iy int, ix int, p int, q double, w double")
    out = harmonise.complete_columns(cells, ["member"], (2000, 2000)).first()
    assert out.points == 6 and out.missing == pytest.approx(0.2)
    assert harmonise.complete_columns(cells, ["member"], (2000, 2000), most_missing=0.1).isEmpty()


def test_density_of_points_on_a_line_is_null(spark):
    grid = spark.createDataFrame([(0.0, 0.0)], "gx double, gy double")
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)] + [(float("nan"), 1.0)], "x double, y double")
    few = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (2.0, 5.0)], "x double, y double")
    cloud = spark.createDataFrame([(float(i % 5), float(i // 5)) for i in range(25)] + [(None, 3.0)], "x double, y double")
    from isobar.operators import geometry

    assert [geometry.kde_2d(p, grid, "x", "y", 0.5).first().density for p in (line, few)] == [None, None]
    assert 0.01 < geometry.kde_2d(cloud, grid, "x", "y", 0.5).first().density < 0.1


def test_the_moist_term_is_split_by_saturation(spark):
    # Moisture follows saturation pressure exactly: nothing is left for humidity.
    es = lambda t: 611.2 * math.exp(17.67 * (t - 273.15) / (t - 29.65))
    rows = [("c", y, 1, 0, 1.0, 0.01 * es(t) / es(280.0), 3.0, 4.0, 1.0, 1.0, t) for y, t in ((0, 280.0), (1, 283.0))]
    cells = spark.createDataFrame(rows, "corridor string, year int, month int, cell int, p double, q double, u double, v double, w double, aw double, t double")
    cells = cells.withColumns({f"q{c}": F.col("q") * F.col(c) for c in ("u", "v")})
    draws = [np.zeros((10, 1), int), np.zeros((10, 1), int)]
    out = {r.term: r for r in dec.window_summary(cells, ["corridor"], ([0], [1]), draws, []).collect()}
    rise = 0.01 * (es(283.0) / es(280.0) - 1) * 5
    assert set(out) == {*dec.TERMS, *dec.MOIST_TERMS}
    assert [out["moist"].point, out["moist_cc"].point, out["total"].ci_lo, out["dmag"].ci_hi] == [pytest.approx(rise)] * 4
    assert out["moist_rh"].point == pytest.approx(0, abs=1e-12) and out["moist"].p == 0 == out["moist"].pfdr


def test_pair_summary_takes_the_tail_beyond_zero(spark):
    # A doubled speed at equal moisture is dynamic alone; the replicates with one early year each vary it.
    series = spark.createDataFrame([("a", 0, 10.0, 2.0), ("a", 1, 14.0, 2.0), ("a", 2, 24.0, 2.0), ("b", 0, 10.0, 2.0), ("b", 1, 30.0, 2.0), ("b", 2, 25.0, 2.0)], "k string, year int, ivt double, iwv double")
    draws = [np.array([[0, 0], [1, 1], [0, 1], [1, 0]]), np.zeros((4, 1), int)]
    out = {r.k: r for r in dec.pair_summary(dec.speed_bootstrap(series, ["k"], ([0, 1], [2]), draws), ["k"]).collect()}
    assert (out["a"].dynamic, out["a"].thermo, out["a"].cross, out["a"].base) == (12.0, 0.0, 0.0, 12.0) and out["a"].percent == 100.0
    assert (out["a"].p, out["b"].p) == (0.0, 0.25) and (out["a"].robust, out["b"].robust90) == (True, False)
    assert out["b"].pfdr == 0.25 and out["b"].dynamic_lo95 == pytest.approx(np.percentile([15, -5, 5, 5], 2.5))
