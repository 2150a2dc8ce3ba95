"""Registered queries against DuckDB on the smallest tables, and the streaming and sink helpers."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from isobar.plans import catalogue
from isobar.session import fresh_name, match, new_folder
from isobar.sources import sinks
from isobar.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Thresholds that leave nothing on the smallest tables.
MAY_BE_EMPTY = {"q_ensemble_stats", "q_mode_patterns"}


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    out = catalogue.queries()[name](spark, sf)
    columns = sorted(out.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    assert rows or name in MAY_BE_EMPTY
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.queries()["q_bbox_slice"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "GreaterThanOrEqual(l_shipdate" in scan.split("PushedFilters")[1] and "l_extendedprice" not in scan


def test_a_distinct_count_has_no_sketch_for_each_key(spark, tmp_path):
    rows = [("A", 1), ("A", 1), ("A", 2), ("A", None), (None, 3), ("R", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalogue.queries()["x_approx_distinct"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {("A", 2, True), (None, 1, True), ("R", 0, True)}
    steps = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "approx_count_distinct" in x and "keys=" in x]
    assert steps and not any("l_orderkey" in x.split("keys=")[1].split("]")[0] for x in steps)


def test_match_takes_null_for_equal_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, match_0 string")
    keys = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(r.match_0 for r in match(rows, keys, [(F.col("k"), "k")]).collect()) == ["a", "b"]
    assert [r.match_0 for r in match(rows, keys, [(F.col("k"), "k")], "left_anti").collect()] == ["c"]
    assert fresh_name(rows, "K") == "_K"


def test_sinks(spark, tmp_path):
    years = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year int, v double")
    path = str(tmp_path / "t")
    assert sinks.write_missing_years(years.where("year = 2000"), path) == [2000]
    assert sinks.write_missing_years(years, path) == [2001] and spark.read.parquet(path).count() == 2
    calls = []

    def make(df):
        calls.append(1)
        return df

    for _ in range(2):
        sinks.cached(spark, str(tmp_path / "c"), {"q": 0.85}, years, make)
    sinks.cached(spark, str(tmp_path / "c"), {"q": 0.9}, years, make)
    assert len(calls) == 2
    # Other data of as many rows and the same columns are another table; the same data in another order are not.
    other = sinks.cached(spark, str(tmp_path / "c"), {"q": 0.9}, years.withColumn("v", F.col("v") + 1), make)
    sinks.cached(spark, str(tmp_path / "c"), {"q": 0.9}, years.orderBy(F.desc("year")).repartition(2), make)
    assert len(calls) == 3 and sorted(r.v for r in other.collect()) == [2.0, 3.0]
    long = spark.createDataFrame([("c1", "moist", 1.26, 0.5, 2.0, 0.01)], "c string, term string, point double, lo double, hi double, p double")
    wide = sinks.pivot_terms(long, ["c"], ["moist"], ["point", "lo", "hi", "p"])
    assert sinks.terms_lines(wide.withColumn("o", F.lit(1)), "o", "c", ["moist"]).first().value == r"c1 & +1.3* [+0.5, +2.0] \\"
    assert sinks.to_json_rows(long.select("c")).first().value == '{"c":"c1"}'


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts, id % 2 AS k, double(id) AS v FROM range(24)")
    rows.coalesce(1).write.mode("append").parquet(source)
    query = lambda: streams.write_once(streams.tumbling_sums(streams.read_stream(spark, source, rows.schema), "ts", "v", ["k"], 6, "0 hours"), out, mark, ["k"])
    query().awaitTermination()
    first = spark.read.parquet(out).count()
    query().awaitTermination()
    assert first == spark.read.parquet(out).count() == 6
    seen = []
    streams.on_complete(streams.read_stream(spark, source, rows.schema), str(tmp_path / "m2"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 24
    assert os.path.basename(new_folder(spark, "x")).startswith("isobar-x-")
