"""Sinks: tables by partition, caches by content, text reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import signed, star


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there: Spark's marker of a committed job."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)  # noqa: SLF001


def write_table(df: DataFrame, path: str, partition: list[str] | None = None, overwrite: bool = False) -> None:
    """Parquet with zstandard; with partitions, only those that ``df`` has are replaced."""
    writer = df.write.option("compression", "zstd")
    if partition:
        writer = writer.partitionBy(*partition).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "error").parquet(path)


def write_missing_years(df: DataFrame, path: str, year: str = "year") -> list[int]:
    """Writes the years that the table doesn't have yet, and returns them."""
    spark = df.sparkSession
    have = set()
    if exists(spark, path):
        have = {r[0] for r in spark.read.parquet(path).select(year).distinct().collect()}
    new = sorted(r[0] for r in df.select(year).distinct().collect() if r[0] not in have)
    if new:
        df.where(F.col(year).isin(*new)).write.option("compression", "zstd").partitionBy(year).mode("append").parquet(path)
    return new


def cached(spark: SparkSession, root: str, config: dict, source: DataFrame, make) -> DataFrame:
    """A table that is made once for each configuration and input.

    The key holds the configuration, the input's column names and a digest of
    its content: the rows' number and the sum of their hashes, which doesn't
    depend on their order.  So other data get a table of their own.
    """
    content = source.select(F.xxhash64(*source.columns).cast("decimal(20,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    key = json.dumps([config, source.columns, content.n, str(content.s)], sort_keys=True, default=str)
    path = f"{root}/{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if not exists(spark, path):
        make(source).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def table_lines(df: DataFrame, order: str, cells: list[Column], end: str = r" \\") -> DataFrame:
    """Body lines of a text table, in order: cells joined by " & "."""
    return df.select(F.col(order), F.concat(F.concat_ws(" & ", *cells), F.lit(end)).alias("value")).orderBy(order).select("value")


def terms_lines(terms: DataFrame, order: str, name: str, names: list[str]) -> DataFrame:
    """Terms with interval and mark: columns ``term``, ``term_lo``, ``term_hi``, ``term_p`` for each of ``names``."""
    cells = [F.col(name)]
    for t in names:
        cells.append(F.concat(signed(t), star(f"{t}_p"), F.lit(" ["), signed(f"{t}_lo"), F.lit(", "), signed(f"{t}_hi"), F.lit("]")))
    return table_lines(terms, order, cells)


def _marked(value: Column, p: Column, digits: int = 1) -> Column:
    return F.concat(signed(value, digits), F.when(p < 0.05, "*").otherwise(""))


def trends_lines(rows: DataFrame, order: str, name: str, spans: dict[str, list[str]]) -> DataFrame:
    """Trends in per cent a decade with a mark of p: long rows (order, name, span, term, trend, p); spans: {span: terms}."""
    at = lambda s, t, c: F.max(F.when((F.col("span") == s) & (F.col("term") == t), F.col(c)))
    wide = rows.groupBy(order, name).agg(*[at(s, t, c).alias(f"{s}_{t}_{c}") for s, own in spans.items() for t in own for c in ("trend", "p")])
    return table_lines(wide, order, [F.col(name), *[_marked(F.col(f"{s}_{t}_trend"), F.col(f"{s}_{t}_p"), 2) for s, own in spans.items() for t in own]])


def sensitivity_lines(rows: DataFrame, order: str, name: str, lengths: list[int]) -> DataFrame:
    """A line a place and first year of the base, a column a window length ("--" where there is none): rows (order, name, base_start, length, value, p).

    The place's name stands in its first line only.
    """
    pick = lambda n: F.max(F.when(F.col("length") == n, _marked(F.col("value"), F.col("p"))))
    wide = rows.groupBy(order, name, "base_start").agg(*[F.coalesce(pick(n), F.lit("--")).alias(f"l{n}") for n in lengths],)
    first = F.row_number().over(Window.partitionBy(order).orderBy("base_start")) == 1
    wide = wide.withColumn("_first", first).withColumn("_line", F.concat(F.concat_ws(" & ", F.when(F.col("_first"), F.col(name)).otherwise(""), F.col("base_start").cast("string"), *[F.col(f"l{n}") for n in lengths]), F.lit(r" \\")))
    return wide.select(F.col(order), "base_start", F.col("_line").alias("value"))


def seasons_lines(rows: DataFrame, order: str, name: str, terms: list[str], seasons: tuple[str, ...] = ("DJF", "MAM", "JJA", "SON")) -> DataFrame:
    """Each season's terms with a mark of p: rows (order, name, season, term, value, p)."""
    at = lambda s, t, c: F.max(F.when((F.col("season") == s) & (F.col("term") == t), F.col(c)))
    wide = rows.groupBy(order, name).agg(*[at(s, t, c).alias(f"{s}_{t}_{c}") for s in seasons for t in terms for c in ("value", "p")])
    return table_lines(wide, order, [F.col(name), *[_marked(F.col(f"{s}_{t}_value"), F.col(f"{s}_{t}_p")) for s in seasons for t in terms]])


def trend_test_lines(observed: DataFrame, models: DataFrame, whole: DataFrame, order: str, name: str, large: list[str]) -> DataFrame:
    """The observed trend, the large models' mean, deviation and extreme share, the weighted range of all members.

    observed: (order, name, obs, p); models: (order, model, mean, sd, extreme);
    whole: (order, weighted_mean, p05, p95, n_extreme).
    """
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = models.groupBy(order).agg(*[at(m, c).alias(f"{m}_{c}") for m in large for c in ("mean", "sd", "extreme")])
    both = observed.join(whole, order).join(wide, order, "left")
    own = [F.when(F.col(f"{m}_mean").isNull(), "--").otherwise(F.concat(signed(f"{m}_mean", 2), F.format_string(r" $\pm$ %.2f (%.0f\,\%%)", F.col(f"{m}_sd"), 100 * F.col(f"{m}_extreme")))) for m in large]
    span = F.concat(signed("weighted_mean", 2), F.lit(" ["), signed("p05", 2), F.lit(", "), signed("p95", 2), F.lit("]"))
    return table_lines(both, order, [F.col(name), _marked(F.col("obs"), F.col("p"), 2), *own, span, F.col("n_extreme").cast("string")])


def pivot_terms(rows: DataFrame, keys: list[str], terms: list[str], values: list[str]) -> DataFrame:
    """Long term rows as one row a key; columns ``term`` and ``term_value``."""
    at = lambda t, v: F.max(F.when(F.col("term") == t, F.col(v))).alias(t if v == "point" else f"{t}_{v}")
    return rows.groupBy(*keys).agg(*[at(t, v) for t in terms for v in values])


def committed(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a partition column (as in the folders' names) whose folders hold a committed job's marker."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}=*/_SUCCESS")
    found = at.getFileSystem(conf).globStatus(at)
    return [f.getPath().getParent().getName().split("=", 1)[1] for f in found or []]


def finished(spark: SparkSession, path: str, column: str) -> set[int]:
    """``committed`` for whole numbers."""
    return {int(v) for v in committed(spark, path, column)}
