"""Ensemble statistics over members of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensemble_stats(members: DataFrame, observed: DataFrame, keys: list[str], value: str = "value", obs: str = "obs", least: int = 5) -> DataFrame:
    """Mean, deviation, z of the observation, share of members at least as extreme, min, max.

    Groups (``keys``) of fewer than ``least`` members are left out; extreme is
    counted on the side of the members' mean that the observation is on.
    """
    both = members.join(observed, [k for k in keys if k in observed.columns])
    both = both.withColumn("_mean", F.avg(value).over(Window.partitionBy(*keys)))
    beyond = F.when(F.col(obs) >= F.col("_mean"), F.col(value) >= F.col(obs)).otherwise(F.col(value) <= F.col(obs))
    out = both.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.first(obs).alias(obs),
        F.avg(beyond.cast("double")).alias("extreme"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    return out.where(F.col("n") >= least).withColumn("z", F.try_divide(F.col(obs) - F.col("mean"), F.col("sd")))


def model_weights(members: DataFrame, model: str, by: list[str]) -> DataFrame:
    """Adds ``w``: each model weighs 1 in its group, its members alike."""
    return members.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by, model)))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, w: str, q: float) -> DataFrame:
    """The least value up to which at least the share ``q`` of the weight lies."""
    order = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.sum(w).over(order) / F.sum(w).over(Window.partitionBy(*by))
    return rows.withColumn("_cum", share).groupBy(*by).agg(F.min(F.when(F.col("_cum") >= q - 1e-12, F.col(value))).alias("quantile"))


def ensemble_quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, quartiles and extremes; null and NaN don't count."""
    clean = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(clean, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(F.count(clean).alias("n"), q.alias("_q"), F.min(clean).alias("low"), F.max(clean).alias("high")).select(*by, "n", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "low", "high")


def complete_members(rows: DataFrame, member: list[str], variable: str, needed: list[str]) -> DataFrame:
    """Members that have every needed variable."""
    return rows.where(F.col(variable).isin(*needed)).groupBy(*member).agg(F.count_distinct(variable).alias("_n")).where(F.col("_n") == len(set(needed))).drop("_n")


def weighted_stats(members: DataFrame, observed: DataFrame, by: list[str], value: str = "value", w: str = "w", obs: str = "obs") -> DataFrame:
    """Weighted mean, 5 and 95 % quantiles, and the share of weight and number of members at least as extreme as the observation.

    Extreme is counted on the side of the weighted mean that the observation is
    on; weights need not sum to one.
    """
    total = F.sum(w).over(Window.partitionBy(*by))
    both = members.join(observed, by).withColumn("_mean", F.sum(F.col(w) * F.col(value)).over(Window.partitionBy(*by)) / total)
    beyond = F.when(F.col(obs) >= F.col("_mean"), F.col(value) >= F.col(obs)).otherwise(F.col(value) <= F.col(obs))
    out = both.groupBy(*by).agg(F.first("_mean").alias("weighted_mean"), F.first(obs).alias(obs), (F.sum(F.when(beyond, F.col(w)).otherwise(0.0)) / F.sum(w)).alias("extreme"), F.count_if(beyond).alias("n_extreme"))
    for q in (0.05, 0.95):
        out = out.join(weighted_quantile(members, by, value, w, q).withColumnRenamed("quantile", f"p{round(100 * q):02d}"), by)
    return out


def drop_empty_models(rows: DataFrame, model: str, value: str) -> DataFrame:
    """Rows of models that have a value other than 0 (null and NaN count as 0)."""
    held = rows.groupBy(model).agg(F.max(F.coalesce(F.abs(F.nanvl(F.col(value).cast("double"), F.lit(0.0))), F.lit(0.0))).alias("_most")).where("_most > 0").select(F.col(model).alias("_model"))
    return rows.join(held, F.col(model).eqNullSafe(F.col("_model")), "left_semi")


def value_lists(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each key's values as one array in the order of ``order`` (a member's number; a key has as many values as members)."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def zip_rows(left: DataFrame, right: DataFrame, by: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of two series side by side by their position in each ``by`` (a series of times).

    ValueError if a key's series differ in length.
    """
    place = lambda df, order: df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    sizes = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy(*by).agg(F.count(F.lit(1)).alias("_b")), by, "full")
    bad = sizes.where("NOT (_a <=> _b)").limit(5).collect()
    if bad:
        raise ValueError(f"series of different lengths: {bad}")
    return place(left, left_order).join(place(right, right_order).drop(right_order), [*by, "_place"]).drop("_place")
