import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import components, detection, events, fields
from isobar.sources import schemas


def band(dy=1, n=60, start=(20, 40), width=2):
    """Cells of a diagonal band on a quarter-degree grid from 25 N, 210 E."""
    out = set()
    for i in range(n):
        for k in range(width):
            out.add((start[0] + dy * i + k, start[1] + i))
    return sorted(out)


def frame(cells, u=200.0, v=200.0):
    iy, ix = np.array(cells).T
    return iy, ix, 25 + 0.25 * iy, 210 + 0.25 * ix, np.full(len(iy), u), np.full(len(iy), v)


def test_objects_are_kept_by_shape():
    assert detection.keep_objects(*frame(band(n=90, width=3))).all()
    disk = [(60 + y, 80 + x) for y in range(-12, 13) for x in range(-12, 13) if y * y + x * x <= 144]
    assert not detection.keep_objects(*frame(disk)).any()
    assert not detection.keep_objects(*frame(band(n=90, width=3), 200.0, -200.0)).any()
    assert not detection.keep_objects(*frame(band(n=18, width=2))).any()
    assert not detection.keep_objects(*frame([(5, 5), (5, 6), (5, 7)])).any()


def test_slices_are_filtered_in_spark(spark):
    iy, ix, lat, lon, u, v = frame(band(n=90, width=3))
    rows = [(t, int(a), int(b), float(c), float(d), float(e), float(f)) for t in (1, 2) for a, b, c, d, e, f in zip(iy, ix, lat, lon, u if t == 1 else -u, v, strict=True)]
    cells = spark.createDataFrame(rows, "ts int, iy int, ix int, lat double, lon double, ivt_u double, ivt_v double")
    out = detection.filter_slices(cells)
    assert out.count() == len(iy) and {r.ts for r in out.select("ts").distinct().collect()} == {1}
    assert detection.filter_slices(cells.limit(0)).count() == 0


def brute(points, near):
    left, out = set(points), {}
    while left:
        todo, own = [min(left)], []
        left.discard(todo[0])
        while todo:
            p = todo.pop()
            own.append(p)
            for q in [q for q in left if all(abs(a - b) <= 1 for a, b in zip(p, q, strict=True)) and near(p, q)]:
                left.discard(q)
                todo.append(q)
        out |= {p: min(own) for p in own}
    return out


def test_labels_match_brute_force():
    rng = np.random.default_rng(0)
    for d, offsets in ((2, components.NEAR_2D), (3, components.NEAR_3D)):
        pts = np.unique(rng.integers(0, 7, (60, d)), axis=0)
        root = components.label(pts, offsets)
        want = brute([tuple(p) for p in pts.tolist()], lambda p, q: True)
        assert [tuple(pts[r].tolist()) for r in root] == [want[tuple(p)] for p in pts.tolist()]


def test_events_cross_chunks(spark):
    rng = np.random.default_rng(1)
    pts = np.unique(np.column_stack([rng.integers(0, 20, 150), rng.integers(0, 6, 150), rng.integers(0, 6, 150)]), axis=0)
    voxels = spark.createDataFrame([("c", *map(int, p)) for p in pts], "cube string, it int, iy int, ix int")
    want = brute([tuple(p) for p in pts.tolist()], lambda p, q: True)
    for chunk in (3, 64):
        out = components.components_3d(voxels, ["cube"], chunk=chunk).collect()
        groups = {}
        for r in out:
            groups.setdefault(r.part, set()).add((r.it, r.iy, r.ix))
        truth = {}
        for p, root in want.items():
            truth.setdefault(root, set()).add(p)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in truth.values()}
    numbered = events.number_events(components.components_3d(voxels, ["cube"], chunk=5), ["cube"])
    assert numbered.agg(F.max("event_id")).first()[0] == len(truth)


VOX = "event_id long, ts timestamp_ntz, lat double, lon double, intensity double, land_sea_mask double"


def voxels(spark, land=1.0):
    base = np.datetime64("2010-01-01T00:00")
    rows = [(1, (base + np.timedelta64(6 * t, "h")).astype("datetime64[s]").item(), 40.0 + y, 230.0 + x, v, land) for t, v in enumerate((300.0, 400.0, 500.0, 400.0)) for y in range(2) for x in range(2)]
    rows += [(2, rows[0][1], 50.0, 200.0, 999.0, 0.0)]
    return spark.createDataFrame(rows, VOX)


def test_event_table(spark):
    out = events.event_table(voxels(spark), [], 1.0, 1.0).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.duration_hours, r.mean_intensity, r.max_intensity) == (24.0, 400.0, 500.0)
    assert r.footprint_area_km2 == pytest.approx(2 * 111 * 111 * (math.cos(math.radians(40)) + math.cos(math.radians(41))))
    assert (r.landfall_lat, r.landfall_lon) == (40.5, 230.5)
    assert events.event_table(voxels(spark, 0.2), [], 1.0, 1.0).first().landfall_lat is None
    assert events.event_table(voxels(spark).limit(0), [], 1.0, 1.0).columns[0] == "event_id"
    assert schemas.empty(spark, schemas.EVENTS).count() == 0


def test_precip_over_a_closed_span(spark):
    own = spark.createDataFrame([(1,), (7,)], "event_id long").join(spark.createDataFrame([(1, "2010-01-01 06:00:00", "2010-01-01 12:00:00"), (7, "2010-01-01 06:00:00", "2010-01-01 12:00:00")], "event_id long, a string, b string").select("event_id", F.to_timestamp_ntz("a").alias("start_time"), F.to_timestamp_ntz("b").alias("end_time")), "event_id")
    cells = spark.createDataFrame([(1, 30.0, 220.0), (1, 30.5, 220.0)], "event_id long, lat double, lon double")
    hours = spark.range(72).select((F.lit("2009-12-31 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), F.lit(220.0).alias("lon"), F.lit(0.001).alias("tp"), F.explode(F.array(F.lit(30.0), F.lit(30.5))).alias("lat"))
    out = {r.event_id: r.precip_total_mm for r in events.attach_precip(own, cells, hours, []).collect()}
    assert out[1] == pytest.approx(13.0) and out[7] is None
    dry = events.attach_precip(own, cells, hours.withColumn("tp", F.lit(0.0)), [])
    assert {r.event_id: r.precip_total_mm for r in dry.collect()} == {1: 0.0, 7: None}


def test_terrain_features_and_verdict(spark):
    v = voxels(spark)
    static = v.select("lat", "lon").distinct().withColumn("elevation_m", F.col("lat") * 10).withColumn("land_sea_mask", F.when(F.col("lon") > 230, 1.0).otherwise(0.0))
    out = {r.event_id: r for r in events.attach_terrain(spark.createDataFrame([(1,), (9,)], "event_id long"), v, static, []).collect()}
    assert out[1].mean_elev_m == pytest.approx(405) and out[1].std_elev_m == pytest.approx(5) and out[1].land_fraction == 0.5 and out[9].max_elev_m is None
    f = events.attach_features(spark.createDataFrame([(1,)], "event_id long"), v, ["intensity"], []).first()
    assert f.lat_deg == 40.5 and f.doy_sin**2 + f.doy_cos**2 == pytest.approx(1)
    t, n = F.lit(True), F.lit(False)
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(events.verdict(t, t, t, F.lit(9.0)), events.verdict(n, n, n, F.lit(-4.9)), events.verdict(t, n, n, F.lit(5.0)), events.verdict(t, n, n, F.lit(2.0)), events.verdict(n, n, t, F.lit(0.0))))).collect()] == ["INTENSIFIED", "FLAT", "MIXED", "FLAT", "MIXED"]


def test_feature_fields(spark):
    rows = [(1, float(p), 30.0 + y, 220.0 + x, 10.0 + (5.0 if p == 250 else 0.0), 0.0, 288.0 - 0.06 * (1000 - p), 0.008 * p / 1000, 9.81 * 8000 * math.log(1000 / p)) for p in (250, 500, 850) for y in range(4) for x in range(4)]
    cells = spark.createDataFrame(rows, "ts int, level double, lat double, lon double, u double, v double, t double, q double, z double")
    out = fields.features(cells).collect()
    assert len(out) == 16
    assert all(r.ivt > 0 and r.ivt_u < 0 and r.theta_e_850 > 280 and r.eady_growth_rate > 0 and r.pv_250 > 0 for r in out)


def test_period_bands_are_those_of_a_bootstrap(spark):
    x = [float(i % 17) for i in range(400)]
    rows = spark.createDataFrame([("a", i, v, 6.0 + v) for i, v in enumerate(x)] + [("b", 9, 5.0, None)], "period string, event_id long, mean_intensity double, duration_hours double")
    out = {r.period: r for r in events.period_bands(rows, []).collect()}
    again = {r.period: r for r in events.period_bands(rows.repartition(7), []).collect()}
    rng = np.random.default_rng(3)
    lo, hi = np.quantile(np.array(x)[rng.integers(0, len(x), (1000, len(x)))].mean(axis=1), [0.05, 0.95])
    assert out["a"].intensity_q05 == pytest.approx(lo, abs=0.08) and out["a"].intensity_q95 == pytest.approx(hi, abs=0.08)
    assert out["a"].duration_q95 == pytest.approx(6 + out["a"].intensity_q95) and again["a"].intensity_q05 == pytest.approx(out["a"].intensity_q05)
    assert (out["b"].intensity_q05, out["b"].intensity_q95, out["b"].duration_q05) == (5.0, 5.0, None)
