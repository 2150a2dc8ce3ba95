"""Crash-safe results, preferred tables, JSON results; state over streams against the batch side."""

import json
import random

import pytest
from pyspark.sql import functions as F

from isobar.sources import results
from isobar.streaming import stateful, streams


def test_models_are_written_one_by_one(spark, tmp_path):
    root, calls = str(tmp_path / "r"), []

    def make(model):
        calls.append(model)
        if model == "bad/one" and len(calls) < 4:
            raise ValueError("broken")
        return spark.createDataFrame([(model, 1.5)], "name string, v double")

    models = ["a", "bad/one", "x=y %"]
    failed = results.run_models(spark, root, models, make)
    assert set(failed) == {"bad/one"} and "broken" in failed["bad/one"] and results.manifest(spark, root) == ["a", "x=y %"]
    # A model that was killed while it was written isn't in the manifest.
    results.write_model(make("b"), root, "b")
    (tmp_path / "r/model=b/_SUCCESS").unlink()
    assert results.manifest(spark, root) == ["a", "x=y %"]
    assert {r.name for r in results.read_models(spark, root).collect()} == {"a", "x=y %"}
    assert results.run_models(spark, root, models, make) == {} and calls == ["a", "bad/one", "x=y %", "b", "bad/one"]
    assert sorted((r.model, r.name) for r in results.read_models(spark, root).collect()) == [("a", "a"), ("bad/one", "bad/one"), ("x=y %", "x=y %")]
    with pytest.raises(LookupError):
        results.read_models(spark, root, ["none"])


def test_full_tables_are_preferred(spark, tmp_path):
    root = str(tmp_path)
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    one(1).write.parquet(f"{root}/contrast_early")
    one(2).write.parquet(f"{root}/contrast_early_partial")
    one(3).write.parquet(f"{root}/contrast_late_partial")
    got = {(r.v, r.partial) for r in results.read_preferred(spark, root, "contrast", ["early", "late", "none"]).collect()}
    assert got == {(1, False), (3, True)} and results.read_preferred(spark, root, "contrast") is None
    one(4).write.parquet(f"{root}/contrast")
    assert results.read_preferred(spark, root, "contrast").collect() == [(4, False)]


def test_results_kept_as_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"north": {"wind": 1.5, "moist": -2}, "south": {"wind": None}}, indent=1))
    got = {(r.corridor, r.term): r.value for r in results.read_nested(spark, str(tmp_path / "a.json"), ["corridor", "term"]).collect()}
    assert got == {("north", "wind"): 1.5, ("north", "moist"): -2.0, ("south", "wind"): None}
    (tmp_path / "v.json").write_text(json.dumps({"y": [1, 2.5], "z": []}))
    assert [tuple(r) for r in results.read_vectors(spark, str(tmp_path / "v.json")).collect()] == [("y", 0, 1.0), ("y", 1, 2.5)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield stateful.stateful_session(spark)
    spark.conf.set(key, before)


def feed(spark, path, rows, parts, seed=0):
    """The rows as files, one a batch: shuffled among neighbours, some twice."""
    dice = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + dice.uniform(-6, 6))
    size = -(-len(order) // parts)
    for k in range(parts):
        own = [rows[i] for i in order[k * size : (k + 1) * size]]
        own += own[:3]  # repeated rows
        spark.createDataFrame(own, "place string, hour int, v double").selectExpr("place", "timestamp'2001-01-30 00:00:00' + make_dt_interval(0, hour) AS ts", "v").coalesce(1).write.mode("append").parquet(path)


def stream_out(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-mark")).option("path", out).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.read.parquet(out)


def test_months_are_given_once_when_complete(rocks, tmp_path):
    spark = rocks
    # From 30 January to 10 April 2001, every six hours; one step of March is missing; then a far row that moves the watermark.
    rows = [("p", 6 * i, float(i % 17)) for i in range(280) if i != 150] + [("p", 24 * 100, 1.0)]
    source = str(tmp_path / "in")
    feed(spark, source, rows, 3)
    read = streams.read_stream(spark, source, spark.read.parquet(source).schema, 1)
    got = {(r.year, r.month): r for r in stream_out(spark, stateful.complete_months(read, "ts", "v", ["place"]), tmp_path, "out").collect()}
    assert got[2001, 2].complete and (got[2001, 2].n, got[2001, 2].expected) == (112, 112)
    held = spark.read.parquet(source).distinct().where("month(ts) = 2").agg(F.avg("v").alias("m"), F.max("v").alias("x")).first()
    assert got[2001, 2].mean == pytest.approx(held.m) and got[2001, 2].most == held.x
    assert not got[2001, 3].complete and got[2001, 3].n == 123 and not got[2001, 1].complete
    assert len(got) == spark.read.parquet(str(tmp_path / "out")).count()


def test_runs_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    spark = rocks
    dice = random.Random(8)
    rows = [(p, 6 * i, dice.uniform(0, 10)) for i in range(120) for p in ("a", "b")] + [(p, 6 * 400, 9.9) for p in ("a", "b")]
    source = str(tmp_path / "in")
    feed(spark, source, rows, 3, 1)
    read = streams.read_stream(spark, source, spark.read.parquet(source).schema, 1)
    out = stream_out(spark, stateful.exceedance_runs(read, "ts", "v", 4.0, ["place"], late="3 days"), tmp_path, "out").collect()
    got = sorted((r.place, r.start_time, r.end_time, r.n, round(r.max_intensity, 9)) for r in out)
    expected = []
    for place in ("a", "b"):
        own = sorted((h, v) for p, h, v in rows if p == place and v > 4 and h < 6 * 400)
        run = []
        for h, v in [*own, (10**6, 0.0)]:
            if run and h - run[-1][0] > 6:
                expected.append((place, run[0][0], run[-1][0], len(run), round(max(v for _, v in run), 9)))
                run = []
            run.append((h, v))
    import datetime as dt

    base = dt.datetime(2001, 1, 30)
    assert got == sorted((p, base + dt.timedelta(hours=a), base + dt.timedelta(hours=b), n, m) for p, a, b, n, m in expected)
