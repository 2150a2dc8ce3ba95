"""Exact quantiles of few groups with many values, from counts that merge.

A value's first bin comes from its sign and the logarithm of its size, so that
bins are the same for all tables and counts of shards can be added up without
reading rows again.  The bin that holds a wanted rank is cut into equal parts of
its own range, again and again, until it holds one value or few enough for one
task; only rows of that range take part.  No task sees the values of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.session import materialize

#: Bins an octave of the first histogram, parts of a bin in later ones, and values that one task may sort.
OCTAVE, PARTS, FINAL = 64, 1024, 10_000
#: Wanted ranks that are broadcast at most; more are joined by shuffle.
BROADCAST_RANKS = 50_000


def bin_of(value: Column) -> Column:
    """A long that never falls as the value rises; equal for values that are about 1 % apart or less."""
    size = F.floor(F.log2(F.abs(value)) * OCTAVE).cast("long") + 2 * 1100 * OCTAVE
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def state(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, metric, bin, n, total, low, high) of finite values; states of several tables merge by ``merge``."""
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(by, values, "metric", "value")
    v = F.col("value")
    return long.where(finite(v)).groupBy(*by, "metric", bin_of(v).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """Adds up states; ``by`` may be fewer columns than they were made with."""
    return states.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def means(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, n, mean, low, high), from states alone."""
    return states.groupBy(*by, "metric").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def _held(counts: DataFrame, wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each wanted rank the cell of ``counts`` (keys, order, n, low, high) that holds it; columns of wanted anew."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(order))
    cells = counts.withColumn("_upto", upto)
    w = wanted.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "rank", "left")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys], F.lit(True))
    inside = (F.col("_upto") > F.col("left")) & (F.col("_upto") - F.col("n") <= F.col("left"))
    return cells.join(w, on & inside).select(*keys, "rank", (F.col("left") - F.col("_upto") + F.col("n")).alias("left"), "low", "high", "n")


def exact(rows: DataFrame, by: list[str], values: list[str], qs: list[float], states: DataFrame | None = None) -> DataFrame:
    """(by, metric, q, value): exact quantiles (linear between neighbours) of each of ``values``; NaN, infinite and null values don't count.

    states: ``state`` of the same rows by ``by``, if it is there already; then
    ``rows`` are read for the bins that hold the quantiles only.
    """
    keys = [*by, "metric"]
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(by, values, "metric", "value").where(finite(F.col("value")))
    first = materialize(state(rows, by, values) if states is None else states.select(*keys, "bin", "n", "total", "low", "high"), "quantile-bins")
    sizes = first.groupBy(*keys).agg(F.sum("n").alias("_n"))
    asked = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_at", F.col("q") * (F.col("_n") - 1))
    asked = materialize(asked.withColumn("_lower", F.floor("_at").cast("long")).withColumn("_upper", F.least(F.floor("_at").cast("long") + 1, F.col("_n") - 1)), "quantile-ranks")
    ranks = asked.select(*keys, F.col("_lower").alias("rank")).unionByName(asked.select(*keys, F.col("_upper").alias("rank"))).distinct()
    held = materialize(_held(first, ranks.withColumn("left", F.col("rank")), keys, "bin"), "quantile-cells")
    while True:
        open_ = held.where((F.col("low") < F.col("high")) & (F.col("n") > FINAL))
        if open_.isEmpty():
            break
        spans = open_.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        inside = _within(long, spans, keys)
        place = F.least(F.floor((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS).cast("long"), F.lit(PARTS - 1).cast("long"))
        counts = inside.groupBy(*keys, "_low", "_high", place.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        ranged = open_.withColumnsRenamed({"low": "_low", "high": "_high"}).drop("n")
        finer = _held(counts, ranged, [*keys, "_low", "_high"], "part").drop("_low", "_high")
        held = materialize(held.where((F.col("low") >= F.col("high")) | (F.col("n") <= FINAL)).unionByName(finer), "quantile-cells")
    known = held.where("low >= high").select(*keys, "rank", F.col("low").alias("value"))
    last = held.where("low < high")
    spans = last.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
    lists = _within(long, spans, keys).groupBy(*keys, "_low", "_high").agg(F.array_sort(F.collect_list("value")).alias("_values"))  # ``FINAL`` values at most
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys], (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")))
    sorted_ = last.join(lists.select(*[F.col(k).alias(f"_l_{k}") for k in keys], "_low", "_high", "_values"), on)
    found = known.unionByName(sorted_.select(*keys, "rank", F.get("_values", F.col("left").cast("int")).alias("value")))
    found = materialize(found, "quantile-values")
    side = lambda n: found.select(*[F.col(k).alias(f"_{n}_{k}") for k in keys], F.col("rank").alias(f"_{n}_rank"), F.col("value").alias(f"_{n}"))
    out = asked
    for n, r in (("a", "_lower"), ("b", "_upper")):
        out = out.join(side(n), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{n}_{k}")) for k in keys], F.col(r) == F.col(f"_{n}_rank")))
    value = F.col("_a") + (F.col("_at") - F.col("_lower")) * (F.col("_b") - F.col("_a"))
    return out.select(*keys, "q", value.alias("value"))


def _within(long: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside of the spans of their group; spans are counted before they are broadcast."""
    side = F.broadcast(spans) if spans.count() <= BROADCAST_RANKS else spans
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], F.col("value").between(F.col("_low"), F.col("_high")))
    return long.join(side, on)


def quantile(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """(by, name): one exact quantile."""
    return exact(rows, by, [value], [q]).select(*by, F.col("value").alias(name))
