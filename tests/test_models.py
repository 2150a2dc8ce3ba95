"""Folds with buffers, scenario scoring and the training table against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from isobar.operators import folds, grid, scenarios, training, trees
from isobar.plans import model_queries
from isobar.sources import sinks


def near(p, b, half=2.5):
    return math.hypot(max(abs(p[0] - b[0]) - half, 0), max(abs(p[1] - b[1]) - half, 0))


@pytest.mark.parametrize("buffer", [0.0, 1.0, 6.0])
def test_buffer_is_the_nested_loop(spark, buffer):
    dice = random.Random(2)
    points = [(i, 25 + dice.random() * 35, 210 + dice.random() * 40) for i in range(400)] + [(1000, 30.0, 212.0), (1001, 30.0, 218.0), (1002, None, 240.0)]
    blocks = [(30.0, 212.5), (42.5, 232.5), (47.5, 232.5)]
    df, side = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(blocks, "block_lat double, block_lon double")
    out = grid.outside_buffer(df, side, buffer, 2.5)
    assert {r.id for r in out.collect()} == {i for i, *p in points if p[0] is None or all(near(p, b) >= buffer for b in blocks)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fold_plan(spark):
    dice = random.Random(4)
    rows = [(i, 25 + dice.random() * 34.9, 210 + dice.random() * 39.9, 1980 + i % 12, dice.random() < 0.2) for i in range(1500)] + [(9000, None, 220.0, 1980, True), (9001, 30.0, 220.0, None, False)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, yr int, mask boolean")
    plan = folds.fold_plan(df, "lat", "lon", F.col("yr"), F.col("mask"))
    found = {r.id: r for r in plan.collect()}
    assert len(found) == len(rows) and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    block = {i: (math.floor((la - 25) / 5), math.floor((lo - 210) / 5)) for i, la, lo, *_ in rows if la is not None}
    held: dict = {}
    for i, *_, mask in rows:
        if i in block:
            held.setdefault(block[i], []).append(mask)
    order = sorted(held, key=lambda b: (sum(held[b]) / len(held[b]), b))
    fold = {b: i % 5 for i, b in enumerate(order)}
    years = {y: i % 5 for i, y in enumerate(sorted(range(1980, 1992), key=lambda y: hashlib.md5(f"{y}:43".encode()).hexdigest()))}
    centre = {b: (25 + (b[0] + 0.5) * 5, 210 + (b[1] + 0.5) * 5) for b in fold}
    for i, la, lo, yr, _ in rows:
        r = found[i]
        assert r.year_fold == years.get(yr, -1)
        if la is None:
            assert (r.spatial_fold, r.near_folds) == (-1, [])
            continue
        assert r.spatial_fold == fold[block[i]] and (r.block_lat, r.block_lon) == centre[block[i]]
        assert set(r.near_folds) == {fold[b] for b, c in centre.items() if near((la, lo), c) < 1.0}
    for k in range(5):
        test, train = ({r.id for r in plan.where(c(k)).collect()} for c in (folds.tested, folds.trained))
        assert not test & train and test == {i for i, r in found.items() if r.spatial_fold == r.year_fold == k}
        away = [c for b, c in centre.items() if fold[b] == k]
        assert all(near((found[i].lat, found[i].lon), c) >= 1.0 for i in train for c in away)


def test_fold_plan_sorts_no_rows_for_its_joins(spark):
    rows = spark.range(50).select((25 + F.col("id") % 35).cast("double").alias("lat"), (210 + F.col("id") % 39).cast("double").alias("lon"), (F.col("id") % 4).alias("yr"), (F.col("id") % 3 > 0).alias("mask"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = folds.fold_plan(rows, "lat", "lon", F.col("yr"), F.col("mask"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") <= 1  # blocks and their neighbours


def test_event_folds_leave_out_the_ocean(spark):
    df = spark.createDataFrame([(i, 25.0 + i % 35, None if i % 7 == 0 else 210.0 + i % 39) for i in range(300)], "id long, landfall_lat double, landfall_lon double")
    plan = folds.event_fold_plan(df, "landfall_lat", "landfall_lon")
    got = {r.spatial_fold for r in plan.where("landfall_lon IS NOT NULL").select("spatial_fold").distinct().collect()}
    assert got == {0, 1, 2, 3, 4} and {r.spatial_fold for r in plan.where("landfall_lon IS NULL").collect()} == {-1}
    # The same folds whatever the partitions.
    again = folds.event_fold_plan(df.repartition(7), "landfall_lat", "landfall_lon")
    assert plan.select("id", "spatial_fold").exceptAll(again.select("id", "spatial_fold")).isEmpty()


def test_cv_report(spark):
    r = folds.cv_report(spark.createDataFrame([(0, 1.0, 0.5), (1, 3.0, 0.7)], "fold int, rmse double, f1 double"), ["rmse", "f1"]).first()
    assert (r.n_folds, r.rmse_mean, r.rmse_std) == (2, 2.0, 1.0) and r.f1_mean == pytest.approx(0.6)


def feature_cube(spark):
    """Four steps on 5 by 6 places, as a scenario's features."""
    rows = [(t, y, x, 25.0 + y, 210.0 + x, *[float(10 * j + t + y) for j in range(6)]) for t in range(4) for y in range(5) for x in range(6)]
    names = ", ".join(f"{c} double" for c in scenarios.PHYSICS)
    return spark.createDataFrame(rows, f"it int, iy int, ix int, lat double, lon double, {names}").withColumn("ts", F.expr("timestamp_ntz'2070-01-01 00:00:00' + make_dt_interval(0, 6 * it)"))


def constant(model, fold, alpha, value, features):
    return (model, 42, fold, alpha, 0, features, 1.0, value, [0.0] * len(features), [-1], [0.0], [0], [0], [0.0], [1], [0.0] * len(features))


def test_nine_columns_in_order_and_fold_means(spark):
    cells = feature_cube(spark)
    matrix = scenarios.stage1_matrix(cells, keep=[])
    assert matrix.columns == ["ivt", "ivt_u", "ivt_v", "theta_e_850", "pv_250", "eady_growth_rate", "lat_deg", "doy_sin", "doy_cos"]
    assert {t for _, t in matrix.dtypes} == {"float"} and matrix.count() == 120
    assert matrix.first().doy_sin == pytest.approx(math.sin(2 * math.pi / 365.25), abs=1e-7)
    models = spark.createDataFrame([constant("stage1", k, None, v, scenarios.STAGE1) for k, v in enumerate((100.0, 200.0, 300.0))], trees.SCHEMA)
    out = scenarios.predict_intensity(scenarios.stage1_matrix(cells), models)
    assert {r.ar_intensity for r in out.collect()} == {200.0} and dict(out.dtypes)["ar_intensity"] == "float"


def test_events_have_their_quantiles_in_order(spark):
    names = {c: float(i) for i, c in enumerate(scenarios.STAGE2)}
    rows = spark.createDataFrame([(1, *names.values()), (2, *[None] * 9)], "event_id long, " + ", ".join(f"{c} double" for c in names))
    models = spark.createDataFrame([constant("stage2", k, a, v + k, scenarios.STAGE2) for k in (0, 1) for a, v in ((0.05, 1.0), (0.5, 5.0), (0.95, 9.0))], trees.SCHEMA)
    out = scenarios.score_events(rows, models)
    assert out.columns == [*rows.columns, "precip_pred_q05_mm", "precip_pred_q50_mm", "precip_pred_q95_mm"]
    assert {(r.precip_pred_q05_mm, r.precip_pred_q50_mm, r.precip_pred_q95_mm) for r in out.collect()} == {(1.5, 5.5, 9.5)}
    with pytest.raises(LookupError):
        scenarios.score_events(rows, models.where("alpha < 0.9"))


def test_delta_cancels_a_constant_bias(spark):
    cells = feature_cube(spark).withColumn("mo", F.lit(1))
    warm = cells.select(*[(F.col(c) + 2.5).alias(c) if c in scenarios.PHYSICS else F.col(c) for c in cells.columns])
    biased = lambda df: df.select(*[(F.col(c) + 100).alias(c) if c in scenarios.PHYSICS else F.col(c) for c in df.columns])
    out = scenarios.delta_features(cells, biased(cells), biased(warm), ["iy", "ix"], "mo")
    assert out.columns == cells.columns and out.select(*warm.columns).exceptAll(warm).isEmpty() and out.count() == cells.count()


def test_cadence_and_share_of_steps(spark):
    df = spark.sql("SELECT timestamp_ntz'2010-01-01 00:00:00' + make_dt_interval(0, cast(id AS int)) AS ts, double(id) AS ivt FROM range(720)")
    assert {r.h for r in training.six_hourly(df).select(F.hour("ts").alias("h")).collect()} == {0, 6, 12, 18} and training.six_hourly(df).count() == 120
    some = training.six_hourly(df, every=4)
    assert some.count() == 30 and some.exceptAll(training.six_hourly(df.repartition(5), every=4)).isEmpty()


@pytest.mark.parametrize("ranges", [1, 256])
def test_balanced_rows_are_the_first_by_digest(spark, ranges):
    rows = [(i, 2000 + i % 3, i % 100 == 0 and i % 3 > 0) for i in range(3000)] + [(5000 + i, 2003, i < 8) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, year int, hit boolean")
    got = {r.id for r in training.balanced(df, "year", F.col("hit"), ["id"], ranges=ranges).collect()}
    expected = set()
    for year in range(2000, 2004):
        own = [(i, hit) for i, y, hit in rows if y == year]
        hits = [i for i, hit in own if hit]
        rest = sorted((i for i, hit in own if not hit), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        expected |= {*hits, *rest[: 3 * len(hits)]}
    assert got == expected


def test_training_table_goes_on_where_it_stopped(spark, tmp_path):
    cells = feature_cube(spark)
    cells = cells.unionByName(cells.withColumn("ts", F.col("ts") + F.expr("interval 1 year")).withColumn("it", F.col("it") + 1000))
    cells = cells.withColumn("ivt", F.when((F.col("iy") == 4) & (F.col("ix") == 5), None).otherwise(F.col("ivt")))
    rows = training.training_rows(cells, cells.where("iy = 1 AND ix < 3"), ["it", "iy", "ix"])
    assert rows.groupBy("year").agg(F.count_if("ar_mask").alias("p"), F.count("*").alias("n")).collect() == [(2070, 12, 48), (2071, 12, 48)]
    assert rows.where("ar_mask AND ar_intensity <> ivt OR NOT ar_mask AND ar_intensity <> 0").isEmpty()
    assert training.training_rows(cells, cells.where("iy = 1"), ["it", "iy", "ix"], ratio=None).count() == 2 * 4 * 29
    path = str(tmp_path / "rows")
    # A job that died inside of a year: files without the marker of a finished one.
    rows.where("year = 2070").drop("year").limit(3).write.parquet(f"{path}/year=2070")
    (tmp_path / "rows/year=2070/_SUCCESS").unlink()
    assert training.build_table(rows, path) == [2070, 2071] and sinks.finished(spark, path, "year") == {2070, 2071}
    first = sorted(map(repr, spark.read.parquet(path).collect()))
    assert len(first) == 96 and training.build_table(rows, path) == [] and training.build_table(rows, path, overwrite=True) == [2070, 2071]
    assert sorted(map(repr, spark.read.parquet(path).collect())) == first


def test_no_detected_cell_is_a_table_without_rows(spark, sf, tmp_path):
    whole = model_queries.q_training_rows(spark, sf)
    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_quantity", F.lit(20.0)).write.parquet(str(tmp_path / "lineitem.parquet"))
    none = model_queries.q_training_rows(spark, str(tmp_path))
    assert none.collect() == [] and none.dtypes == whole.dtypes and not whole.isEmpty()


def test_booster_queries_are_better_than_a_constant(spark, sf):
    rows = {r.spatial_fold: r for r in model_queries.q_ml_stage1(spark, sf).collect()}
    assert set(rows) == {0, 1, 2} and all(r.r2 > 0.8 and r.n_trees > 3 for r in rows.values())
    two = model_queries.q_ml_stage2(spark, sf).collect()
    assert {r.spatial_fold for r in two} == {0, 1} and all(0.75 < r.pi90_coverage <= 1 and r.pinball_q50 > r.pinball_q05 for r in two)
