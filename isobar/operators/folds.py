"""Folds by space and year with a buffer, and the training table that they cut.

Blocks are ranked or permuted, never rows; a row finds its block's neighbours by
an equal block index, so no join compares all rows with all blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_block(rows: DataFrame, lat: str, lon: str, lat0: float, lon0: float, size: float) -> DataFrame:
    """Adds block_i, block_j and the centre block_lat, block_lon; null where the place is missing."""
    i, j = F.floor((F.col(lat) - lat0) / size).cast("int"), F.floor((F.col(lon) - lon0) / size).cast("int")
    own = rows.withColumn("block_i", i).withColumn("block_j", j)
    return own.withColumn("block_lat", lat0 + (F.col("block_i") + 0.5) * size).withColumn("block_lon", lon0 + (F.col("block_j") + 0.5) * size)


def permutation(key: Column, seed: int) -> Column:
    """Text that orders keys at random, alike in every engine with MD5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def fold_plan(rows: DataFrame, lat: str, lon: str, year: Column, mask: Column, k: int = 5, lat0: float = 25.0, lon0: float = 210.0, size: float = 5.0, buffer: float = 1.0, stratify: bool = True, seed: int = 42) -> DataFrame:
    """Adds block_i, block_j, block_lat, block_lon, spatial_fold, year_fold and near_folds.

    Blocks are dealt to spatial folds in the order of their share of ``mask``
    (or, without ``stratify``, of a permutation); years in that of a permutation.
    near_folds holds the spatial folds that have a block closer than ``buffer``
    degrees (0 inside the block; the distance is Euclidean).  Rows without a
    place are in no spatial fold (-1) and near to none.
    """
    own = with_block(rows, lat, lon, lat0, lon0, size).withColumn("_year", year)
    order = [F.avg(F.coalesce(mask, F.lit(False)).cast("double")).alias("_rate")]
    blocks = own.where("block_i IS NOT NULL AND block_j IS NOT NULL").groupBy("block_i", "block_j", "block_lat", "block_lon").agg(*order)
    by = ["_rate", "block_i", "block_j"] if stratify else [permutation(F.concat_ws("/", "block_i", "block_j"), seed)]
    blocks = blocks.withColumn("spatial_fold", ((F.row_number().over(Window.orderBy(*by)) - 1) % k).cast("int"))  # a row a block
    years = own.select("_year").where("_year IS NOT NULL").distinct()
    years = years.withColumn("year_fold", ((F.row_number().over(Window.orderBy(permutation(F.col("_year"), seed + 1), "_year")) - 1) % k).cast("int"))  # a row a year

    reach = math.ceil(buffer / size)
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    around = blocks.select("block_i", "block_j", F.struct("block_lat", "block_lon", "spatial_fold").alias("_b"))
    around = around.withColumn("_di", steps).withColumn("_dj", steps).groupBy((F.col("block_i") + F.col("_di")).alias("block_i"), (F.col("block_j") + F.col("_dj")).alias("block_j")).agg(F.collect_list("_b").alias("_near"))
    known = blocks.select("block_i", "block_j", "spatial_fold").join(around, ["block_i", "block_j"])

    def close(b: Column) -> Column:
        off = [F.greatest(F.abs(F.col(c) - b[n]) - size / 2, F.lit(0.0)) for c, n in ((lat, "block_lat"), (lon, "block_lon"))]
        return F.sqrt(off[0] * off[0] + off[1] * off[1]) < buffer

    out = own.join(F.broadcast(known), ["block_i", "block_j"], "left").join(F.broadcast(years), "_year", "left")  # a row a block, a row a year
    near = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("_near", F.array().cast("array<struct<block_lat:double,block_lon:double,spatial_fold:int>>")), close), lambda b: b["spatial_fold"])))
    columns = [c for c in rows.columns]
    return out.select(*columns, "block_i", "block_j", "block_lat", "block_lon", F.coalesce("spatial_fold", F.lit(-1)).alias("spatial_fold"), F.coalesce("year_fold", F.lit(-1)).alias("year_fold"), near.alias("near_folds"))


def tested(k: int) -> Column:
    """Rows of a ``fold_plan`` that fold ``k`` is scored on."""
    return (F.col("spatial_fold") == k) & (F.col("year_fold") == k)


def trained(k: int) -> Column:
    """Rows that fold ``k`` learns from: of other blocks and years, outside the buffer."""
    return (F.col("spatial_fold") != k) & (F.col("spatial_fold") >= 0) & (F.col("year_fold") != k) & ~F.array_contains("near_folds", k)


def event_fold_plan(rows: DataFrame, lat: str, lon: str, k: int = 5, **where) -> DataFrame:
    """``fold_plan`` of events by landfall: blocks permuted, no years; events without landfall are in no fold."""
    out = fold_plan(rows, lat, lon, F.lit(0), F.lit(False), k, stratify=False, **where)
    return out.drop("year_fold")


def event_trained(k: int) -> Column:
    return (F.col("spatial_fold") != k) & (F.col("spatial_fold") >= 0) & ~F.array_contains("near_folds", k)


def cv_report(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations of per-fold metrics."""
    return metrics.agg(F.count(F.lit(1)).alias("n_folds"), *[f for c in columns for f in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
