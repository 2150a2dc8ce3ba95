import math

import pytest
from pyspark.sql import functions as F

from isobar.functions import scalars
from isobar.operators import grid
from isobar.sources import harmonise

G = scalars.G


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_boxes_are_closed_and_wrap(spark):
    cells = spark.createDataFrame([(30.0, 350.0), (40.0, 10.0), (41.0, 0.0), (35.0, 180.0)], "lat double, lon double")
    assert rows(grid.box(cells, (40.0, 30.0), (350.0, 10.0))) == [(30.0, 350.0), (40.0, 10.0)]
    assert rows(grid.box(cells, (30.0, 41.0), (0.0, 180.0))) == [(35.0, 180.0), (40.0, 10.0), (41.0, 0.0)]


def test_end_dates_are_whole_days(spark):
    t = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2000-01-01 00:00:00'), (timestamp_ntz'2000-01-02 23:59:59'), (timestamp_ntz'2000-01-03 00:00:00') AS t(ts)")
    assert grid.whole_days(t, "ts", "2000-01-01", "2000-01-02").count() == 2


def test_layer_weights_sum_to_the_air_above_ground(spark):
    levels = [(c, p, ps) for c, ps in ((1, 950.0), (2, 400.0), (3, 100.0)) for p in (200.0, 500.0, 850.0, 1000.0)]
    w = grid.layer_weights(spark.createDataFrame(levels, "c int, p double, ps double"), ["c"])
    sums = {r.c: r.s for r in w.groupBy("c").agg(F.sum("w").alias("s")).collect()}
    assert sums[1] * G == pytest.approx(950 - 200) and sums[2] * G == pytest.approx(400 - 200) and sums[3] == 0


def test_vertical_integral_of_a_uniform_column(spark):
    cells = spark.createDataFrame([(1, p, 2.0, 3.0, -4.0) for p in (200.0, 500.0, 1000.0)], "c int, p double, q double, u double, v double")
    r = grid.vertical_integral(cells, ["c"]).first()
    assert r.iwv == pytest.approx(2 * 800 / G) and r.ivt == pytest.approx(2 * 5 * 800 / G)
    assert grid.vertical_integral(cells, ["c"], sign=-1).first().ivt_u == pytest.approx(-r.ivt_u)


def test_nearest_join_has_a_tolerance_and_earlier_ties(spark):
    left = spark.createDataFrame([(0.0,), (5.0,), (20.0,)], "t double")
    right = spark.createDataFrame([(-1.0, "a"), (1.0, "b"), (6.9, "c"), (30.0, "d")], "t double, v string")
    assert [(r.t, r.v) for r in grid.nearest(left, right, "t", "v", 2.0).orderBy("t").collect()] == [(0.0, "a"), (5.0, "c"), (20.0, None)]


def test_bilinear_and_conservative(spark):
    cells = spark.createDataFrame([(1, float(y), float(x), 10.0 * y + x) for y in range(3) for x in range(3)], "k int, y double, x double, val double")
    target = spark.createDataFrame([(0.5, 1.25), (2.0, 2.0), (2.5, 0.0)], "y double, x double")
    out = {(r.y, r.x): r.val for r in grid.bilinear(cells, target, "y", "x", "val", ["k"]).collect()}
    assert out[(0.5, 1.25)] == pytest.approx(6.25) and out[(2.0, 2.0)] == pytest.approx(22.0) and (2.5, 0.0) not in out
    src = cells.select("k", "val", F.col("y").alias("y_lo"), (F.col("y") + 1).alias("y_hi"), F.col("x").alias("x_lo"), (F.col("x") + 1).alias("x_hi"))
    big = spark.createDataFrame([(0.0, 3.0, 0.0, 1.5)], "y_lo double, y_hi double, x_lo double, x_hi double")
    assert grid.conservative(src, big, "y", "x", "val", ["k"]).first().val == pytest.approx(10 + (0 * 1 + 1 * 0.5) / 1.5)


def test_buffer_is_strict(spark):
    points = spark.createDataFrame([(30.0, 212.0), (30.0, 218.0), (30.0, 240.0)], "lat double, lon double")
    block = spark.createDataFrame([(30.0, 212.5)], "block_lat double, block_lon double")
    assert sorted(r.lon for r in grid.outside_buffer(points, block, 1.0, 2.5).collect()) == [218.0, 240.0]
    assert grid.outside_buffer(points, block, 0.0, 2.5).count() == 3


def test_cadence_is_found(spark):
    hourly = spark.range(24).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    six = spark.range(28).select(F.timestamp_seconds(F.col("id") * 21600).alias("ts"))
    assert grid.stride(hourly, "ts", 6).count() == 4 and grid.stride(six, "ts", 6).count() == 28


def test_thresholds_have_a_floor(spark):
    cells = spark.createDataFrame([(1, 260.0), (2, 250.0), (3, 300.0), (4, None)], "c int, x double")
    clim = spark.createDataFrame([(1, 100.0), (3, 400.0)], "c int, clim double")
    out = {r.c: (r.limit, r.exceeds) for r in grid.threshold(cells, clim, ["c"], "x", 250.0).collect()}
    assert out == {1: (250.0, True), 2: (250.0, False), 3: (400.0, False), 4: (250.0, None)}


def test_merge_keeps_the_left_value(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, u double, w double")
    b = spark.createDataFrame([(1, 9.0, 7.0), (3, 3.0, 8.0)], "k int, u double, w double")
    assert sorted(tuple(r) for r in grid.merge_override(a, b, ["k"]).collect()) == [(1, 1.0, 7.0), (2, 2.0, 5.0), (3, 3.0, 8.0)]


def test_physics_against_known_values(spark):
    r = spark.range(1).select(
        scalars.saturation_pressure(F.lit(20.0)).alias("es"),
        scalars.potential_temperature(F.lit(85000.0), F.lit(280.0)).alias("th"),
        scalars.equivalent_potential_temperature(F.lit(85000.0), F.lit(293.0), F.lit(0.0124)).alias("the"),
        scalars.dewpoint(F.lit(85000.0), F.lit(0.01)).alias("td"),
        scalars.lon360(F.lit(-150.0)).alias("e"),
        scalars.lon180(F.lit(210.0)).alias("w"),
    ).first()
    assert r.es == pytest.approx(2337, rel=2e-3) and r.th == pytest.approx(293.3, abs=0.2) and 340 < r.the < 352
    assert r.td == pytest.approx(11.3, abs=0.5) and (r.e, r.w) == (210.0, -150.0)


def test_bands_are_right_closed(spark):
    x = spark.createDataFrame([(25.0,), (35.0,), (35.1,), (60.0,), (61.0,)], "x double")
    out = [r.b for r in x.select(scalars.right_closed_band("x", [25.0, 35.0, 45.0, 60.0], ["s", "m", "n"]).alias("b")).collect()]
    assert out == ["s", "s", "m", "n", None]


def test_names_spans_and_seasons(spark):
    first, last = scalars.year_span("p")
    out = spark.createDataFrame([("1980-2014",), ("1998",)], "p string").select(first.alias("a"), last.alias("b")).collect()
    assert [tuple(r) for r in out] == [(1980, 2014), (1998, 1998)]
    assert spark.range(1).select(scalars.region_key(F.lit("West-Coast 2")).alias("k")).first().k == "westcoast2"
    assert set(scalars.SEASONS["DJF"]) == {12, 1, 2}


def test_harmonise(spark):
    raw = spark.createDataFrame([(50000.0, 40.0, -150.0, float("nan"), 2.0)], "plev double, latitude double, longitude double, hus double, zg double")
    r = harmonise.harmonise(raw, level_in_pa=True, height_not_geopotential=True).first()
    assert (r.level, r.lat, r.lon, r.q) == (500.0, 40.0, 210.0, None) and r.z == pytest.approx(2 * G)


def test_text_tables_and_catalog(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1948 2020\n 1948 " + " ".join(["1.5"] * 11) + " -99.90\n1949 " + " ".join(str(i) for i in range(12)) + "\n end\n")
    out = harmonise.read_month_table(spark, str(tmp_path / "m.txt"))
    assert out.count() == 23 and out.where("year = 1949 and month = 12").first().value == 11.0
    (tmp_path / "c.csv").write_text("source,variable,version,zstore\na,q,1,s1\na,q,2,s2\nb,q,1,s3\n")
    cat = harmonise.read_catalog(spark, str(tmp_path / "c.csv"), source="a")
    assert harmonise.latest_stores(cat, ["source"]).first().zstore == "s2"
    with pytest.raises(LookupError):
        harmonise.read_catalog(spark, str(tmp_path / "c.csv"), source=["x", "y"])


def test_cell_area(spark):
    a = spark.range(1).select(grid.cell_area(F.lit(60.0), F.lit(1.0), F.lit(2.0)).alias("a")).first().a
    assert a == pytest.approx(111 * 222 * math.cos(math.radians(60)))
