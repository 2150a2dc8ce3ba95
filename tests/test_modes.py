"""Modes against NumPy's decomposition; attribution, index regression and fingerprint checks on planted signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import modes, trends
from isobar.operators.decomposition import moistening


def field(spark, x, lats, lons, extra=()):
    rows = [(t, float(la), float(lo), float(x[t, i, j])) for t in range(x.shape[0]) for i, la in enumerate(lats) for j, lo in enumerate(lons)]
    return spark.createDataFrame([*rows, *extra], "t long, lat double, lon double, z double").repartition(23)


@pytest.mark.parametrize("positive", [True, False])
def test_modes_are_those_of_the_weighted_matrix(spark, positive):
    rng = np.random.default_rng(1)
    lats, lons, n = np.array([-60.0, -10.0, 35.0, 80.0]), np.array([0.0, 40.0, 200.0]), 17
    x = rng.normal(size=(n, 4, 3)) + 50
    # A place without all times, one with NaN, a repeated row.
    extra = [(0, 10.0, 10.0, 1.0), *[(t, 11.0, 10.0, math.nan if t == 3 else 1.0) for t in range(n)], (2, -60.0, 0.0, float(x[2, 0, 0]))]
    found = modes.modes(field(spark, x, lats, lons, extra), "t", ["lat", "lon"], "z", "lat", 3, ({"lat": 36.0, "lon": 199.0}, positive))
    w = np.sqrt(np.cos(np.radians(lats)))
    a = ((x - x.mean(axis=0)) * w[:, None]).reshape(n, -1)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    patterns = vt[:3].reshape(3, 4, 3) / w[None, :, None]
    sign = np.sign(patterns[:, 2, 2]) * (1 if positive else -1)
    pcs = u[:, :3] * s[:3] * sign
    assert found.times == list(range(n)) and np.allclose(found.shares, (s**2 / (s**2).sum())[:3])
    assert np.allclose(found.pcs, pcs / pcs.std(axis=0))
    got = {(r.mode, r.lat, r.lon): r.pattern for r in found.patterns().collect()}
    assert len(got) == 36 and all(np.isclose(v, sign[m - 1] * patterns[m - 1, list(lats).index(la), list(lons).index(lo)]) for (m, la, lo), v in got.items())
    table = found.table(spark).collect()
    assert len(table) == 51 and {r.mode for r in table} == {1, 2, 3}


def test_one_pattern_explains_all(spark):
    a, b = np.sin(np.arange(12)), np.arange(1.0, 7.0).reshape(2, 3)
    found = modes.modes(field(spark, a[:, None, None] * b, [10.0, 20.0], [1.0, 2.0, 3.0]), "t", ["lat", "lon"], "z", "lat", 2)
    assert found.shares[0] == pytest.approx(1.0) and abs(np.corrcoef(found.pcs[:, 0], a)[0, 1]) == pytest.approx(1.0)
    # Without a probe the largest value of a series is positive.
    assert found.pcs[np.abs(found.pcs[:, 0]).argmax(), 0] > 0


def test_fields_without_complete_cells(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0)], "t long, lat double, lon double, z double")
    found = modes.modes(df, "t", ["lat", "lon"], "z", "lat", 2, ({"lat": 1.0}, True))
    assert found.table(spark).where("pc <> 0 OR share <> 0").isEmpty() and found.patterns().isEmpty()
    assert modes.modes(df.limit(0), "t", ["lat", "lon"], "z", "lat", 2).table(spark).isEmpty()


def series(spark, n=90):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(n, 3))
    rows = [("signal", i, *map(float, p[i]), float(2 * p[i, 0] - p[i, 1] + 0.1 * rng.normal())) for i in range(n)]
    rows += [("noise", i, *map(float, p[i]), float(rng.normal())) for i in range(n)] + [("short", 0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "name string, year int, pc1 double, pc2 double, pc3 double, v double")


def test_ridge_and_forest_find_what_is_there(spark):
    df, names = series(spark), ["pc1", "pc2", "pc3"]
    ridge = {(r.name, r.term): r for r in modes.ridge_table(df, ["name"], "year", "v", names, np.logspace(-2, 3, 20)).collect()}
    good, bad = ridge["signal", "pc1"], ridge["noise", "pc1"]
    assert good.r2_cv > 0.97 and bad.r2_cv < 0.2 and good.importance > ridge["signal", "pc2"].importance > ridge["signal", "pc3"].importance
    assert ridge["short", "pc1"].coef is None and good.n == 90 and good.coef > 0 > ridge["signal", "pc2"].coef
    forest = {r.name: r.r2 for r in modes.block_cv(df, "name", "year", "v", names, modes.forest(40)).collect()}
    assert 0.6 < forest["signal"] < good.r2_cv and forest["noise"] < 0.2
    # The same folds and a linear model of the library: no worse than the forest on a line.
    from pyspark.ml.regression import LinearRegression

    line = {r.name: r.r2 for r in modes.block_cv(df, "name", "year", "v", names, lambda: LinearRegression(labelCol="y", predictionCol="said")).collect()}
    assert line["signal"] > 0.97


def test_ridge_from_sums_is_ridge_from_rows(spark):
    df = series(spark).where("name <> 'short'")
    got = {r.name: r.r2 for r in modes.ridge_cv_sums(df, ["name"], "year", "v", "pc1", "pc2", 1.0).collect()}
    for name in ("signal", "noise"):
        part = df.where(F.col("name") == name).orderBy("year").toPandas()
        x, y = part[["pc1", "pc2"]].to_numpy(), part.v.to_numpy()
        said = np.empty(90)
        for k in range(5):
            lo, hi = 90 * k // 5, 90 * (k + 1) // 5
            rest = np.r_[0:lo, hi:90]
            m, c = x[rest].mean(axis=0), y[rest].mean()
            coef = np.linalg.solve((x[rest] - m).T @ (x[rest] - m) + np.eye(2), (x[rest] - m).T @ (y[rest] - c))
            said[lo:hi] = c + (x[lo:hi] - m) @ coef
        assert got[name] == pytest.approx(1 - ((y - said) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_attribution_rows(spark):
    df = series(spark, 40).where("name <> 'short'")
    pcs = df.where("name = 'signal'").unpivot(["year"], ["pc1", "pc2"], "m", "pc").select(F.substring("m", 3, 1).cast("int").alias("mode"), F.col("year").cast("long").alias("time"), "pc")
    values = df.select("name", "year", "v", (100 + 2.0 * F.col("year")).alias("w"))
    rows = modes.attribution_rows(values, pcs, "name", "year", "v", {"w": "w"}, modes.forest(10)).collect()
    assert {(r.name, r.term) for r in rows} == {(n, t) for n in ("signal", "noise") for t in ("pc1", "pc2")}
    assert all(r.top_mode == "pc1" for r in rows if r.name == "signal") and all(r.r2_forest is not None for r in rows)
    assert all(r.w_trend == pytest.approx(2000 / 139) and r.w_p < 1e-6 for r in rows)


def test_index_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    years = np.arange(1950, 2020)
    i1, i2 = rng.normal(size=70) + 0.02 * (years - 1950), rng.normal(size=70)
    t = (years - years.mean()) / 10
    d1 = i1 - np.polyval(np.polyfit(t, i1, 1), t)
    y = 5 + 0.7 * t + 2 * d1 / d1.std(ddof=1) + 0.01 * rng.normal(size=70)
    df = spark.createDataFrame([("a", int(a), float(b), float(c), float(v)) for a, b, c, v in zip(years, i1, i2, y, strict=True)] + [("b", 2000, 1.0, 1.0, 1.0)], "k string, yr int, i1 double, i2 double, y double")
    rows = {r.label: r for r in trends.index_regression(df, ["k"], "yr", "y", ["i1", "i2"], (1950, 1969), (2000, 2019)).collect()}
    assert set(rows) == {"const", "trend_per_decade", "i1", "i2"}
    assert [rows[x].coef for x in ("const", "trend_per_decade", "i1")] == pytest.approx([5, 0.7, 2], abs=0.01)
    assert rows["i1"].p < 1e-10 < 0.01 < rows["i2"].p and rows["const"].corr is None and rows["i1"].corr_p < 0.01
    # Without the index only the trend is left between the windows.
    assert rows["i1"].diff_index_removed == pytest.approx(0.7 * 5, abs=0.02) and rows["i1"].r2_full > 0.999
    # Detrended predictors have no slope: r2 of the indices lacks the trend's share.
    assert 0 < rows["i1"].r2_indices < rows["i1"].r2_full


def test_fingerprint_checks(spark):
    seasonal = spark.createDataFrame([("all", 5.0, 1.0), ("none", -1.0, -2.0), ("gap", None, 1.0)], "r string, pre double, monsoon double")
    drivers = spark.createDataFrame([("all", "eff", -6.0), ("all", "cape", 2.9), ("none", "eff", 6.0), ("none", "cape", -3.0), ("gap", "eff", 6.0), ("gap", "cape", None)], "r string, driver string, trend double")
    places = spark.createDataFrame([("all", True, 4.0), ("all", False, 1.0), ("none", True, 1.0), ("none", False, 4.0), ("gap", True, None), ("gap", False, 1.0)], "r string, local boolean, trend double")
    got = {x.r: x[-3:] for x in trends.fingerprint(seasonal, drivers, places, ["r"]).collect()}
    assert got == {"all": (True, True, True), "none": (False, False, False), "gap": (False, False, False)}


def test_percent_trend_and_moistening(spark):
    df = spark.createDataFrame([("a", y, 10.0 + 0.1 * (y - 2000)) for y in range(2000, 2010)] + [("b", y, 1.0) for y in range(2000, 2003)], "k string, yr int, v double")
    got = {r.k: r.trend for r in trends.percent_trend(df, ["k"], "yr", "v", 6).collect()}
    assert got["a"] == pytest.approx(100 * 1.0 / 10.45) and got["b"] is None
    r = moistening(spark.createDataFrame([(20.0, 21.4, 100.0, 110.0, 280.0, 281.0)], "iwv0 double, iwv1 double, ivt0 double, ivt1 double, t0 double, t1 double")).first()
    assert (r.moist_percent, r.ivt_percent, r.rate, r.expected) == pytest.approx((7.0, 10.0, 7.0, 7.0))


def test_correlation_p(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=30)
    b = a + rng.normal(size=30)
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, b, strict=True)] + [("one", 1.0, 2.0)], "k string, a double, b double")
    rows = {r.k: r for r in trends.correlation_p(df, ["k"], "a", "b").collect()}
    r = np.corrcoef(a, b)[0, 1]
    t = abs(r) * math.sqrt(28 / (1 - r * r))
    x = np.linspace(0, t, 200001)
    density = (1 + x * x / 28) ** -14.5 * math.exp(math.lgamma(14.5) - math.lgamma(14)) / math.sqrt(28 * math.pi)
    assert rows["k"].p == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-8) and (rows["one"].p is None or math.isnan(rows["one"].p))
