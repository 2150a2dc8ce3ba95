"""Ordered operators: running means, ranks, false-discovery control, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import col


def running_mean(value: str, order: str, width: int, least: int | None = None, by: list[str] | None = None) -> Column:
    """Centred mean over ``width`` rows; null where fewer than ``least`` (default all) are there."""
    half = width // 2
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) >= (width if least is None else least), F.avg(value).over(w))


def zscore(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1; ties share the mean of theirs."""
    order = Window.partitionBy(*by).orderBy(value)
    peers = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], name: str = "pfdr") -> DataFrame:
    """Adds adjusted p: the least of p * m / rank over this and all larger p, at most 1."""
    up = Window.partitionBy(*by).orderBy(F.col(p).asc())
    m = F.count(p).over(Window.partitionBy(*by))
    raw = rows.where(F.col(p).isNotNull()).withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    # Range frames take equal p together, so that ties get one value whatever their order.
    down = Window.partitionBy(*by).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(name, F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_raw")


def islands(rows: DataFrame, by: list[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """Runs of rows with a true flag: those rows, with a number of their run."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    begins = F.when(F.col("_flag") & ~F.coalesce(F.lag("_flag").over(w), F.lit(False)), 1).otherwise(0)
    numbered = marked.withColumn("_begins", begins).withColumn(name, F.sum("_begins").over(w))
    return numbered.where("_flag").drop("_flag", "_begins")


def emergence(rows: DataFrame, by: list[str], year: str, value: str, base: tuple[int, int]) -> DataFrame:
    """First year whose Theil-Sen line exceeds the base years' mean plus one deviation."""
    from isobar.operators.trends import theil_sen

    in_base = F.when(F.col(year).between(*base), F.col(value))
    limit = rows.groupBy(*by).agg((F.avg(in_base) + F.stddev_pop(in_base)).alias("limit"))
    fit = theil_sen(rows, by, year, value).join(limit, by)
    line = F.col("intercept") + F.col("slope") * F.col(year)
    return rows.join(fit, by).groupBy(*by).agg(F.first("slope").alias("slope"), F.min(F.when(line > F.col("limit"), F.col(year))).alias("emerges"))


def monotone(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Whether each value is at least the one before it."""
    w = Window.partitionBy(*by).orderBy(order)
    step = rows.withColumn("_up", F.col(value) >= F.lag(value).over(w))
    return step.groupBy(*by).agg(F.coalesce(F.bool_and("_up"), F.lit(True)).alias("monotone"))


def contiguous_folds(by: list[str], order: str, k: int) -> Column:
    """Fold of each position when n rows are cut at floor(n * i / k)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    # The largest f with floor(n * f / k) <= i.
    guess = F.floor((i * k) / n)
    return F.when(F.floor(n * (guess + 1) / k) <= i, guess + 1).otherwise(guess).cast("int")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same ones whatever the partitions."""
    return rows.orderBy(F.xxhash64(col(key), F.lit(seed)), key).limit(n)


def stratified_sample(rows: DataFrame, positive: Column, key: str, ratio: int = 3, seed: int = 42) -> DataFrame:
    """All positives, and ``ratio`` times as many others, chosen by a hash; none without positives.

    The number to take is joined as one row; ranks are found inside 1,024
    hash ranges, whose sizes are summed up, so that no task ranks all rows.
    """
    marked = rows.withColumn("_pos", F.coalesce(positive, F.lit(False)))
    wanted = F.broadcast(marked.agg((F.sum(F.col("_pos").cast("long")) * ratio).alias("_want")))
    others = marked.where("not _pos").withColumn("_h", F.xxhash64(col(key), F.lit(seed))).withColumn("_range", F.shiftright("_h", 54))
    sizes = others.groupBy("_range").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    ranked = others.join(F.broadcast(before), "_range").withColumn("_rank", F.col("_before") + rank)
    taken = ranked.crossJoin(wanted).where(F.col("_rank") <= F.col("_want"))
    return marked.where("_pos").select(*rows.columns).unionByName(taken.select(*rows.columns))
