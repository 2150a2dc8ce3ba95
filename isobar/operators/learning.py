"""Folds by blocks, metrics of predictions, buckets of attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- folds --------------------------------------------------------------------


def block_index(lat: str, lon: str, lat0: float, lon0: float, size: float = 5.0) -> Column:
    """Number of the square block that a point lies in."""
    return (F.floor((F.col(lat) - lat0) / size) * 1000 + F.floor((F.col(lon) - lon0) / size)).cast("int")


def ranked_folds(rows: DataFrame, block: str, rate: Column, k: int) -> DataFrame:
    """Adds ``fold``: blocks ranked by their rate and dealt in turn; only blocks are ranked."""
    blocks = rows.groupBy(block).agg(rate.alias("_rate"))
    blocks = blocks.withColumn("fold", ((F.row_number().over(Window.orderBy("_rate", block)) - 1) % k).cast("int"))
    return rows.join(F.broadcast(blocks.select(block, "fold")), block)


def permuted_folds(rows: DataFrame, block: str, valid: Column, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: blocks in the order of a hash, dealt in turn; -1 where ``valid`` isn't true."""
    blocks = rows.where(valid).select(block).distinct()
    blocks = blocks.withColumn("fold", ((F.row_number().over(Window.orderBy(F.xxhash64(block, F.lit(seed)), block)) - 1) % k).cast("int"))
    both = rows.join(F.broadcast(blocks), block, "left")
    return both.withColumn("fold", F.when(F.coalesce(valid, F.lit(False)), F.col("fold")).otherwise(-1))


# --- metrics ------------------------------------------------------------------


def _mean(value: Column, weight: str | None) -> Column:
    """The mean of values that aren't null; with ``weight`` each counts as often as that says."""
    if weight is None:
        return F.avg(value)
    return F.try_divide(F.sum(value * F.col(weight)), F.sum(F.when(value.isNotNull(), F.col(weight))))


def regression_metrics(rows: DataFrame, by: list[str], y: str, pred: str, threshold: float, weight: str | None = None) -> DataFrame:
    """RMSE, R2, and precision, recall and F1 of exceeding ``threshold``; weight: how many rows a row stands for."""
    hit, said = F.col(y) > threshold, F.col(pred) > threshold
    n = lambda c: F.sum(F.when(c, 1 if weight is None else F.col(weight)).otherwise(0))
    e, above = F.col(y) - F.col(pred), F.col(y) - threshold
    var = F.var_pop(y) if weight is None else _mean(above * above, weight) - _mean(above, weight) * _mean(above, weight)
    s = rows.groupBy(*by).agg(_mean(e * e, weight).alias("_mse"), var.alias("_var"), n(hit & said).alias("_tp"), n(~hit & said).alias("_fp"), n(hit & ~said).alias("_fn"))
    p, q = F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return s.select(*by, F.sqrt("_mse").alias("rmse"), (1 - F.try_divide(F.col("_mse"), F.col("_var"))).alias("r2"), p.alias("precision"), q.alias("recall"), F.try_divide(2 * p * q, p + q).alias("f1"))


def pinball(y, pred, alpha: float, weight: str | None = None) -> Column:
    d = F.col(y) - F.col(pred)
    return _mean(F.greatest(alpha * d, (alpha - 1) * d), weight)


def coverage(y: str, low: str, high: str, weight: str | None = None) -> Column:
    """Share of rows inside the closed interval."""
    return _mean(F.col(y).between(F.col(low), F.col(high)).cast("double"), weight)


# --- attributions ----------------------------------------------------------------


def bucket_sums(rows: DataFrame, key: str, buckets: dict[str, list[str]]) -> DataFrame:
    """Sums of absolute attributions by named group of features."""
    return rows.select(key, *[sum([F.abs(c) for c in cs], F.lit(0.0)).alias(name) for name, cs in buckets.items()])
