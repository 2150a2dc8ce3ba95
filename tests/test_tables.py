"""Ensemble statistics with weights, lists and zips, text tables, text sources."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from isobar.functions.scalars import scaled_round
from isobar.operators import ensemble, grid
from isobar.sources import harmonise, sinks


def test_models_of_unequal_size_weigh_alike(spark):
    rows = [("a", "t", 1.0)] * 4 + [("b", "t", 5.0), ("c", "t", 9.0)]
    m = ensemble.model_weights(spark.createDataFrame(rows, "model string, term string, value double"), "model", ["term"])
    r = ensemble.weighted_stats(m, spark.createDataFrame([("t", 5.0)], "term string, obs double"), ["term"]).first()
    assert (r.weighted_mean, r.n_extreme, r.p05, r.p95) == (pytest.approx(5.0), 2, 1.0, 9.0) and r.extreme == pytest.approx(2 / 3)
    low = ensemble.weighted_stats(m, spark.createDataFrame([("t", 0.5)], "term string, obs double"), ["term"]).first()
    assert (low.extreme, low.n_extreme) == (0.0, 0)


def test_empty_models_lists_and_zips(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, None), ("b", 2, 3.0), ("b", 1, None), ("c", 1, float("nan")), (None, 1, -2.0)], "model string, k int, v double")
    assert {r.model for r in ensemble.drop_empty_models(df, "model", "v").collect()} == {"b", None}
    assert ensemble.value_lists(df.where("model = 'b'"), ["model"], "k", "v").first().values == [None, 3.0]
    left = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 1, "d")], "k string, t int, v string")
    right = spark.createDataFrame([("x", 10, "A"), ("x", 30, "C"), ("y", 5, "D")], "k string, t2 int, w string")
    assert sorted((r.v, r.w) for r in ensemble.zip_rows(left, right, ["k"], "t", "t2").collect()) == [("a", "A"), ("c", "C"), ("d", "D")]
    with pytest.raises(ValueError, match="lengths"):
        ensemble.zip_rows(left, right.where("w <> 'C'"), ["k"], "t", "t2")


def test_text_tables(spark):
    t = spark.createDataFrame([(1, "North", "full", "wind", -1.234, 0.01), (1, "North", "sat", "wind", 0.5, 0.2), (2, "South", "full", "wind", None, None)], "o int, name string, span string, term string, trend double, p double")
    assert [r.value for r in sinks.trends_lines(t, "o", "name", {"full": ["wind"], "sat": ["wind"]}).collect()] == [r"North & -1.23* & +0.50 \\", r"South & - & - \\"]
    s = spark.createDataFrame([(1, "N", 1990, 20, 1.0, 0.01), (1, "N", 1980, 10, 2.0, 0.5), (1, "N", 1980, 20, -3.0, 0.5)], "o int, name string, base_start int, length int, value double, p double")
    assert [r.value for r in sinks.sensitivity_lines(s, "o", "name", [10, 20]).orderBy("base_start").collect()] == [r"N & 1980 & +2.0 & -3.0 \\", r" & 1990 & -- & +1.0* \\"]
    z = spark.createDataFrame([(1, "N", "DJF", "wind", 1.0, 0.01), (1, "N", "JJA", "wind", 2.0, 0.5)], "o int, name string, season string, term string, value double, p double")
    assert sinks.seasons_lines(z, "o", "name", ["wind"]).first().value == r"N & +1.0* & - & +2.0 & - \\"
    obs = spark.createDataFrame([(1, "N", 0.456, 0.01)], "o int, name string, obs double, p double")
    models = spark.createDataFrame([(1, "m1", 0.1, 0.2, 0.05)], "o int, model string, mean double, sd double, extreme double")
    whole = spark.createDataFrame([(1, 0.2, -0.1, 0.5, 3)], "o int, weighted_mean double, p05 double, p95 double, n_extreme int")
    line = sinks.trend_test_lines(obs, models, whole, "o", "name", ["m1", "m2"]).first().value
    assert line == r"N & +0.46* & +0.10 $\pm$ 0.20 (5\,\%) & -- & +0.20 [-0.10, +0.50] & 3 \\"


def test_three_fixed_levels(spark):
    df = spark.createDataFrame([("a", 250.0, 1.0), ("a", 500.0, 2.0), ("a", 850.0, 4.0), ("b", 250.0, 1.0)], "k string, p double, q double")
    out = grid.three_level_integral(df, ["k"], "p", {250.0: 0, 500.0: 1, 850.0: 2}, "q").collect()
    assert [(r.k, r.q) for r in out] == [("a", pytest.approx((12500 + 60000 + 70000) / 9.80665))]


def test_text_sources(spark, tmp_path):
    (tmp_path / "oni.txt").write_text(" SEAS  YR   TOTAL   ANOM \n  DJF 1950   24.72  -1.53\n  JFM 1950   25.17  -1.47\n  DJF 1951   25.00   0.50\nnot a row\n")
    assert {r.year: r.value for r in harmonise.read_oni(spark, str(tmp_path / "oni.txt")).collect()} == {1950: pytest.approx(-1.5), 1951: 0.5}
    folder = str(tmp_path / "cells")
    rows = [(y, dt.datetime(y, 1, 1), -150.0 + y % 2, 30.0, 10.0, float("nan") if y == 2001 else 9.80665) for y in range(2000, 2004)]
    sinks.write_table(spark.createDataFrame(rows, "year int, valid_time timestamp_ntz, longitude double, latitude double, ua double, zg double"), folder, ["year"])
    got = {r.year: r for r in harmonise.read_cells(spark, None, folder, 2001, 2002, height_not_geopotential=True).collect()}
    assert set(got) == {2001, 2002} and got[2001].z is None and got[2002].z == pytest.approx(9.80665**2) and got[2002].lon == 210.0 and got[2001].u == 10.0
    assert harmonise.read_cells(spark, folder, "nowhere", 2000, 2003).count() == 4
    plan = harmonise.read_years(spark, folder, 2001, 2002)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    named = str(tmp_path / "1998_pl.parquet")
    spark.range(1).write.parquet(named + "/1998_01")
    assert harmonise.topography(spark.createDataFrame([(-150.0, 30.0, 98.0665, 1.0)], "longitude double, latitude double, z double, lsm double")).first()[2] == pytest.approx(10.0)
    (tmp_path / "files").mkdir()
    (tmp_path / "files/1998_pl.txt").write_text("x\n")
    assert spark.read.text(str(tmp_path / "files")).select(harmonise.year_of_file().alias("y")).first().y == 1998
    months = spark.createDataFrame([(1, 2000, m) for m in range(1, 13)], "k int, year int, month int")
    assert harmonise.assert_months(months, ["k"]).count() == 12
    with pytest.raises(ValueError, match="12 months"):
        harmonise.assert_months(months.where("month < 12"), ["k"])
    both = harmonise.concat_first([months.withColumn("v", F.lit(1)), months.withColumn("v", F.lit(2)).withColumn("k", F.col("k") + F.col("month") % 2)], ["k", "year", "month"])
    assert both.groupBy("v").count().orderBy("v").collect() == [(1, 12), (2, 6)]


def test_ties_but_for_the_last_bits_are_rounded_as_in_sql(spark):
    dice = random.Random(3)
    values = [sum(v + step * 2.0**-39 for v in (dice.randrange(40_000_000) / 20000, dice.randrange(10))) for step in (-2, -1, 0, 1, 2) for _ in range(400)] + [-0.00005, 14701.484649999999, 0.0]
    sql = [r[0] for r in duckdb.execute("SELECT round(v, 4) FROM (SELECT unnest(CAST(? AS DOUBLE[])) AS v)", [values]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i")
    assert [r.v for r in rows.select(scaled_round("v", 4).alias("v")).collect()] == sql
    assert [r.v for r in rows.select(F.round("v", 4).alias("v")).collect()] != sql
