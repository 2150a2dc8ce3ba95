"""Exact quantiles and mergeable states."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import quantiles, shards

QS = [0.0, 0.05, 0.5, 0.85, 0.999, 1.0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, a double, b double").repartition(5)


def drawn(n=4000):
    dice = random.Random(1)
    rows = [("many", dice.gauss(0, 1), dice.lognormvariate(0, 4)) for _ in range(n)] + [("ties", float(dice.randint(-1, 1)), 7.25) for _ in range(n)]
    rows += [(None, 1000 + i / 7, -1e-300 * i) for i in range(500)] + [("one", -3.5, None), ("odd", math.nan, math.inf), ("odd", 2.0, None), ("odd", None, -0.0)]
    return rows


@pytest.mark.parametrize("final", [3, 50, 10_000])
def test_exact_quantiles(spark, monkeypatch, final):
    monkeypatch.setattr(quantiles, "FINAL", final)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    rows = drawn()
    got = {(r.k, r.metric, r.q): r.value for r in quantiles.exact(frame(spark, rows), ["k"], ["a", "b"], QS).collect()}
    expected = {}
    for k in {r[0] for r in rows}:
        for j, metric in ((1, "a"), (2, "b")):
            v = [r[j] for r in rows if r[0] == k and r[j] is not None and math.isfinite(r[j])]
            expected |= {(k, metric, q): float(np.quantile(v, q)) for q in QS if v}
    assert got.keys() == expected.keys() and all(got[x] == pytest.approx(v, rel=1e-12, abs=0) for x, v in expected.items())


def test_bins_never_fall(spark):
    values = sorted({*[s * 2.0**e * m for s in (-1, 1) for e in (-1074, -1022, -1, 0, 1, 1023) for m in (1, 1.5)], 0.0, *np.random.default_rng(0).normal(size=500).tolist()})
    bins = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select("v", quantiles.bin_of(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins) and len(set(bins)) > 100


def test_no_groups_and_no_rows(spark):
    df = frame(spark, drawn(300)).where("k = 'many'")
    v = sorted(r.a for r in df.collect())
    assert quantiles.quantile(df, [], "a", 0.85, "x").first().x == pytest.approx(float(np.quantile(v, 0.85)))
    assert quantiles.exact(df.limit(0), ["k"], ["a"], [0.5]).isEmpty()


def events(spark, n=900):
    dice = random.Random(4)
    rows = [(i, "early" if i % 3 else "late", str(i % 4), dice.uniform(200, 500), dice.uniform(300, 700), dice.uniform(1e4, 1e6), 6.0 * dice.randint(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, period string, chunk string, mean_intensity double, max_intensity double, footprint_area_km2 double, duration_hours double")


def test_chunks_add_up_to_one_run(spark, tmp_path):
    df = events(spark).cache()
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    for period in ("early", "late"):
        own = df.where(F.col("period") == period)
        shards.write_chunk(own, whole, period, "all")
        for chunk in "0123":
            shards.write_chunk(own.where(F.col("chunk") == chunk), parts, period, chunk)
    shards.write_chunk(df.where("period = 'early' AND chunk = '2'"), parts, "early", "2")  # again: replaced, not added
    one, two = (sorted(map(tuple, shards.summary(spark, x).collect())) for x in (whole, parts))
    assert [x[:2] for x in one] == [x[:2] for x in two] == [("early", 600), ("late", 300)]
    assert all(a[2:] == pytest.approx(b[2:]) for a, b in zip(one, two, strict=True))
    one, two = (sorted(map(tuple, shards.bands(spark, x, ["mean_intensity", "duration_hours"], [0.05, 0.95]).collect())) for x in (whole, parts))
    assert one == two and len(one) == 8
    v = [r.mean_intensity for r in df.where("period = 'late'").collect()]
    assert dict((x[:3], x[3]) for x in two)["late", "mean_intensity", 0.95] == pytest.approx(float(np.quantile(v, 0.95)))
