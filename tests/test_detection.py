"""Detection against plain loops: objects by shape, events over slices, their table."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import detection, events, grid
from isobar.plans import catalogue, event_queries

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def groups(points, near):
    """Sets of points that touch, by flooding."""
    left, out = set(points), []
    while left:
        found, todo = set(), [left.pop()]
        while todo:
            p = todo.pop()
            found.add(p)
            for d in near:
                q = tuple(a + b for a, b in zip(p, d, strict=True))
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(found)
    return out


def hull_area(xy):
    """From the edges that have all points on one side."""
    pts = sorted(set(xy))
    ring = set()
    for i, a in enumerate(pts):
        for b in pts[i + 1 :]:
            side = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for c in pts]
            if all(s >= -1e-6 for s in side) or all(s <= 1e-6 for s in side):
                ring |= {a, b}
    mx, my = (sum(p[k] for p in ring) / len(ring) for k in (0, 1))
    ring = sorted(ring, key=lambda p: math.atan2(p[1] - my, p[0] - mx))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def wanted(cells):
    """Whether an object (rows of one slice) is kept: size, length, ratio, direction."""
    if len(cells) < 5:
        return False
    lat = sum(c.lat for c in cells) / len(cells)
    lon = sum(c.lon for c in cells) / len(cells)
    xy = [((c.lon - lon) * 111.0 * math.cos(math.radians(lat)), (c.lat - lat) * 111.0) for c in cells]
    length, area = max(math.dist(a, b) for a in xy for b in xy), hull_area(xy)
    if area < 1e-3 or length < 2000 or length * length / area < 2:
        return False
    mean = [sum(p[k] for p in xy) / len(xy) for k in (0, 1)]
    sxx, syy, sxy = (sum((p[a] - mean[a]) * (p[b] - mean[b]) for p in xy) for a, b in ((0, 0), (1, 1), (0, 1)))
    angle = 0.5 * math.atan2(2 * sxy, sxx - syy)
    u, v = sum(c.ivt_u for c in cells), sum(c.ivt_v for c in cells)
    return math.hypot(u, v) > 0 and abs(math.cos(angle) * u + math.sin(angle) * v) / math.hypot(u, v) >= math.cos(math.radians(45))


def expected(rows: pd.DataFrame, floor: float):
    """Events as lists of cells, in the order of their first cells."""
    limit = rows.groupby(["month", "iy", "ix"])["ivt"].quantile(0.85).clip(lower=floor).rename("limit")
    over = rows.join(limit, on=["month", "iy", "ix"]).query("ivt > limit")
    kept = {}
    for it, part in over.groupby("it"):
        at = {(c.iy, c.ix): c for c in part.itertuples()}
        for found in groups(at, NEAR):
            if wanted([at[p] for p in found]):
                kept |= {(it, *p): at[p] for p in found}
    return sorted((sorted((p, kept[p]) for p in found) for found in groups(kept, [(t, *d) for t in (-1, 0, 1) for d in NEAR])), key=lambda e: e[0][0])


def test_query_equals_plain_loops(spark, sf01):
    want = expected(event_queries._object_cells(spark, sf01).toPandas(), 20.0)
    found = event_queries._detected(spark, sf01).select("event_id", "it", "iy", "ix").collect()
    assert {(r.event_id, r.it, r.iy, r.ix) for r in found} == {(i, *p) for i, e in enumerate(want, 1) for p, _ in e} and len(want) > 3
    table = {r.event_id: r for r in catalogue.queries()["q_detect_events"](spark, sf01).collect()}
    assert set(table) == {i for i, e in enumerate(want, 1) if len(e) >= 2}
    for i, e in enumerate(want, 1):
        cells = [c for _, c in e]
        assert table[i].mean_intensity == pytest.approx(sum(c.ivt for c in cells) / len(cells), abs=1e-5)
        assert table[i].footprint_area_km2 == pytest.approx(sum(555.0**2 * math.cos(math.radians(a)) for a, _ in {(c.lat, c.lon) for c in cells}), rel=1e-6)
        hours = (max(c.ts for c in cells) - min(c.ts for c in cells)).total_seconds() / 3600 + 6
        assert table[i].duration_hours == hours


def planted(spark):
    """Three slices: a band along the transport that drifts; a band across it; a round one; a short one."""
    rows = []
    for it in range(3):
        for iy in range(30):
            for ix in range(40):
                band = abs(iy - (10 + it)) <= 1 and 2 <= ix <= 20
                across = 24 <= ix <= 25 and iy >= 15
                disc = (iy - 22) ** 2 + (ix - 10) ** 2 <= 9
                short = iy == 2 and 34 <= ix <= 37
                rows.append((it, 1, iy, ix, 30.0 + iy, 100.0 + 2 * ix, 10.0, 0.0, 300.0 if band or across or disc or short else 50.0))
    cells = spark.createDataFrame(rows, "it int, month int, iy int, ix int, lat double, lon double, ivt_u double, ivt_v double, ivt double")
    return cells.withColumn("ts", F.timestamp_seconds(F.col("it") * 21600))


def test_only_long_objects_along_the_transport_stay(spark):
    cells = planted(spark)
    clim = cells.select("iy", "ix").distinct().withColumn("clim", F.lit(60.0))
    found = detection.detect_events(cells, clim, ["iy", "ix"], 100.0)
    assert {r.event_id for r in found.select("event_id").collect()} == {1}
    assert {(r.it, r.iy) for r in found.select("it", "iy").collect()} == {(t, y) for t in range(3) for y in (9 + t, 10 + t, 11 + t)}
    assert found.count() == 3 * 3 * 19
    none = detection.detect_events(cells, clim, ["iy", "ix"], 300.0)
    assert none.count() == 0 and set(none.columns) == {*cells.columns, "event_id"}


def test_cells_without_climatology_meet_the_floor(spark):
    cells = planted(spark)
    found = detection.detect(cells, grid.quantile_climatology(cells.where("iy < 0"), ["iy", "ix"], "ivt"), ["iy", "ix"], 100.0)
    assert found.count() == 3 * 3 * 19


def test_events_are_numbered_across_ranges(spark):
    parts = [5, 5, 7, -3, 10**12, 10**12 + 1, 99]
    voxels = spark.createDataFrame([(c, p) for c in ("a", "b") for p in parts[: 7 if c == "a" else 3]], "cube string, part long")
    for keys, rows in (([], voxels.where("cube = 'a'").select("part")), (["cube"], voxels)):
        out = {(getattr(r, "cube", "a"), r.part, r.event_id) for r in events.number_events(rows, keys, ranges=4).collect()}
        want = {("a", p, i) for i, p in enumerate(sorted(set(parts)), 1)} | ({("b", 5, 1), ("b", 7, 2)} if keys else set())
        assert out == want
    assert events.number_events(voxels.where("false"), ["cube"]).count() == 0
