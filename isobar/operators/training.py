"""The training table: detected cells and as many others as asked for, by year.

A year is a partition that is written as a whole (its folder is replaced), so a
job that was killed or is repeated leaves the same table, and years that are
finished are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isobar.operators.scenarios import PHYSICS, STAGE1, stage1_matrix
from isobar.session import materialize
from isobar.sources import sinks


def six_hourly(cells: DataFrame, ts: str = "ts", every: int = 1, seed: int = 42) -> DataFrame:
    """Steps at 0, 6, 12 and 18 hours; of these the share 1 / ``every`` of each year's, by a hash of the step.

    floor(n / every) of a year's n steps stay, in the order of MD5 of step and
    seed.  Only steps are ranked (at most 1,464 a year), cells are joined.
    """
    kept = cells.where(F.hour(ts).isin(0, 6, 12, 18) & (F.minute(ts) == 0))
    if every <= 1:
        return kept
    steps = kept.select(F.col(ts).alias("_step")).distinct().withColumn("_year", F.year("_step"))
    rank = F.row_number().over(Window.partitionBy("_year").orderBy(F.md5(F.concat(F.date_format("_step", "yyyy-MM-dd HH"), F.lit(f":{seed}"))), "_step"))
    n = F.count(F.lit(1)).over(Window.partitionBy("_year"))
    taken = steps.withColumn("_rank", rank).withColumn("_n", n).where(F.col("_rank") <= F.floor(F.col("_n") / every)).select("_step")
    return kept.join(taken, F.col(ts) == F.col("_step"), "left_semi")


def balanced(rows: DataFrame, by: str, positive: Column, key: list[str], ratio: int = 3, seed: int = 42, ranges: int = 256) -> DataFrame:
    """In each ``by``: all positives and ``ratio`` times as many others (all, if fewer), chosen by MD5 of their key.

    The order of the others is cut into ``ranges`` by the digest's first bits;
    ranges that are wholly in need no rank, and rows are ranked only inside the
    one range that holds the last of them.  No positives: no rows at all.
    """
    marked = rows.withColumn("_pos", F.coalesce(positive, F.lit(False))).withColumn("_h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed)))))
    marked = marked.withColumn("_range", F.when(~F.col("_pos"), F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * ranges / 65536).cast("int")))
    sizes = marked.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    positives = sizes.where("_range IS NULL").select(F.col(by), (F.col("_n") * ratio).alias("_want"))
    window = Window.partitionBy(by).orderBy("_range")
    plan = sizes.where("_range IS NOT NULL").withColumn("_upto", F.sum("_n").over(window)).join(positives, by)
    # Ranges with all rows in, and the one with some; at most ``ranges`` rows a year.
    plan = plan.where(F.col("_upto") - F.col("_n") < F.col("_want")).select(by, "_range", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"), (F.col("_upto") > F.col("_want")).alias("_part"))
    others = marked.where("NOT _pos").join(plan, [by, "_range"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", *key))
    cut = others.where("_part").withColumn("_rank", rank).where("_rank <= _left")
    columns = rows.columns
    return marked.where("_pos").select(*columns).unionByName(others.where("NOT _part").select(*columns)).unionByName(cut.select(*columns))


def training_rows(cells: DataFrame, mask: DataFrame, keys: list[str], ratio: int | None = 3, seed: int = 42) -> DataFrame:
    """Flat rows for the intensity models: keys, ts, lat, lon, year, the nine features, ar_mask, ar_intensity.

    mask: the detected (keys); ar_intensity is the transport inside of it, 0
    outside.  Rows with a missing feature are left out.  ratio: others for each
    positive row of a year; None keeps all rows (the table that is held out).
    """
    flat = cells.dropna(subset=PHYSICS).join(mask.select(*keys).distinct().withColumn("ar_mask", F.lit(True)), keys, "left")
    flat = flat.withColumn("ar_mask", F.coalesce("ar_mask", F.lit(False))).withColumn("year", F.year("ts")).withColumn("ar_intensity", F.when(F.col("ar_mask"), F.col("ivt")).otherwise(0.0).cast("float"))
    rows = stage1_matrix(flat, keep=[*keys, "ts", "lat", "lon", "year", "ar_mask", "ar_intensity"])
    rows = rows.select(*keys, "ts", "lat", "lon", "year", *STAGE1, "ar_mask", "ar_intensity")
    if ratio is None:
        return rows
    # Read twice below (counts, then rows): written once.
    return balanced(materialize(rows, "training-cells"), "year", F.col("ar_mask"), keys, ratio, seed)


def build_table(rows: DataFrame, path: str, overwrite: bool = False) -> list[int]:
    """Writes ``rows`` by year; years that are there stay unless ``overwrite``.  Returns the years written.

    A year's folder is replaced as a whole and the job is committed at its end;
    after a job that died before its end the year is not listed as there.
    """
    spark = rows.sparkSession
    years = sorted(r[0] for r in rows.select("year").distinct().collect())
    have = set() if overwrite else sinks.finished(spark, path, "year")
    new = [y for y in years if y not in have]
    for year in new:  # one commit a year, as a killed job loses one year at most
        sinks.write_table(rows.where(F.col("year") == year).drop("year"), f"{path}/year={year}", overwrite=True)
    return new


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``build_table`` has written of rows of this schema: no rows if no year had any."""
    if not sinks.finished(spark, path, "year"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
