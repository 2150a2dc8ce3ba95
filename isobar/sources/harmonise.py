"""Ingest: one vocabulary of names and units, NaN as null, longitudes from 0 to 360."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import G, lon360, no_nan

#: Names that sources give to an axis or a field, and ours (fixed values).
NAMES = {
    "ts": ("ts", "time", "valid_time"),
    "level": ("level", "plev", "pressure_level", "isobaricInhPa"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "u": ("u", "ua", "u_component_of_wind"),
    "v": ("v", "va", "v_component_of_wind"),
    "t": ("t", "ta", "temperature"),
    "q": ("q", "hus", "specific_humidity"),
    "z": ("z", "zg", "geopotential"),
    "sp": ("sp", "ps", "surface_pressure"),
    "tp": ("tp", "total_precipitation"),
    "land_sea_mask": ("land_sea_mask", "lsm"),
}


def rename(cells: DataFrame, names: dict[str, tuple[str, ...]] = NAMES) -> DataFrame:
    """Columns under our names; the first alias that the frame has wins."""
    out, lower = cells, {c.lower(): c for c in cells.columns}
    for own, aliases in names.items():
        found = next((lower[a.lower()] for a in aliases if a.lower() in lower), None)
        if found is not None and found != own:
            out = out.withColumnRenamed(found, own)
    return out


def harmonise(cells: DataFrame, level_in_pa: bool = False, height_not_geopotential: bool = False, humidity_in_g: bool = False) -> DataFrame:
    """Names, NaN, longitudes and units as the canonical tables have them.

    Whether a source has Pa, geometric height or g/kg is a parameter of the
    source; nothing is guessed from the values.
    """
    out = rename(cells)
    for f in out.schema.fields:
        if f.dataType.typeName() in ("float", "double"):
            out = out.withColumn(f.name, no_nan(f.name))
    if "lon" in out.columns:
        out = out.withColumn("lon", lon360("lon"))
    if level_in_pa:
        out = out.withColumn("level", F.col("level") / 100.0)
    if height_not_geopotential:
        out = out.withColumn("z", F.col("z") * G)
    if humidity_in_g:
        out = out.withColumn("q", F.col("q") / 1000.0)
    return out


def read_years(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Cells of a table partitioned by year; only those years' folders are listed and read."""
    return spark.read.parquet(path).where(F.col("year").between(first, last))


def read_cells(spark: SparkSession, local: str | None, staged: str, first: int, last: int, **units: bool) -> DataFrame:
    """The local copy where one is configured, the staged table otherwise."""
    return harmonise(read_years(spark, local or staged, first, last), **units)


def year_of_file() -> Column:
    """Year at the start of the name of the file that a row comes from."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4})", 1).cast("int")


def topography(static: DataFrame) -> DataFrame:
    """Elevation and land share from a surface geopotential."""
    return harmonise(static).select("lat", "lon", (F.col("z") / G).alias("elevation_m"), "land_sea_mask")


def read_catalog(spark: SparkSession, path: str, **facets) -> DataFrame:
    """Rows of a catalog CSV by facets (a value or a list); LookupError if none is left."""
    rows = spark.read.option("header", True).csv(path)
    for name, wanted in facets.items():
        rows = rows.where(F.col(name).isin(*wanted) if isinstance(wanted, list | tuple) else F.col(name) == wanted)
    if rows.isEmpty():
        raise LookupError(f"no store in the catalog for {facets}")
    return rows


def latest_stores(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """The store of the newest version for each key."""
    return catalog.groupBy(*keys).agg(F.max_by("zstore", "version").alias("zstore"), F.max("version").alias("version"))


#: Marks of missing values in index files (fixed values), and the size from which a value is none.
MISSING, NONE_FROM = (-99.99, -99.9, -9.9, -999.0), 90.0


def read_month_table(spark: SparkSession, path: str, missing: tuple[float, ...] = MISSING) -> DataFrame:
    """(year, month, value) of text rows "year v1 ... v12"; other rows, marks of missing values and sizes of ``NONE_FROM`` or more go."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where((F.size("w") == 13) & F.col("w")[0].rlike(r"^\d{4}$"))
    long = rows.select(F.col("w")[0].cast("int").alias("year"), F.posexplode(F.slice("w", 2, 12)).alias("i", "value"))
    return long.select("year", (F.col("i") + 1).alias("month"), F.col("value").try_cast("double").alias("value")).where(~F.col("value").isin(*missing) & (F.abs("value") < NONE_FROM))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(year, month, value) of text rows of just those three columns."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where((F.size("w") == 3) & F.col("w")[0].rlike(r"^\d{4}$"))
    return rows.select(F.col("w")[0].cast("int").alias("year"), F.col("w")[1].try_cast("int").alias("month"), F.col("w")[2].try_cast("double").alias("value")).where("value IS NOT NULL")


def read_oni(spark: SparkSession, path: str) -> DataFrame:
    """(year, value): yearly means of the last column of text rows "season year total anomaly"; the heading and other rows go."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where(F.size("w") == 4)
    parsed = rows.select(F.col("w")[1].try_cast("int").alias("year"), F.col("w")[3].try_cast("double").alias("value"))
    return parsed.where("year IS NOT NULL AND value IS NOT NULL").groupBy("year").agg(F.avg("value").alias("value"))


def complete_columns(cells: DataFrame, keys: list[str], years: tuple[int, int], least_points: int = 4, most_missing: float = 0.25, weight: str = "w") -> DataFrame:
    """Members whose columns may be used: all years there, enough valid points, not too much of their weight missing.

    A point that is null at every level and time (a mask in the store) isn't valid and takes no part in the share.
    """
    points = cells.groupBy(*keys, "iy", "ix").agg(
        (F.count("q") > 0).alias("_valid"), F.sum(F.when(F.col("q").isNull(), F.col(weight)).otherwise(0.0)).alias("_missing"), F.sum(weight).alias("_weight")
    )
    valid = lambda c: F.sum(F.when(F.col("_valid"), F.col(c)))
    points = points.groupBy(*keys).agg(F.count_if("_valid").alias("points"), F.try_divide(valid("_missing"), valid("_weight")).alias("missing"))
    used = cells.groupBy(*keys).agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"), F.count_distinct("year").alias("_ny")).join(points, keys)
    n = years[1] - years[0] + 1
    ok = (F.col("_y0") <= years[0]) & (F.col("_y1") >= years[1]) & (F.col("_ny") >= n) & (F.col("points") >= least_points) & (F.coalesce("missing", F.lit(0.0)) <= most_missing)
    return used.where(ok).drop("_y0", "_y1", "_ny")


def assert_months(series: DataFrame, keys: list[str], months: int = 12) -> DataFrame:
    """The series, or an error in the task that finds a year without all of its months."""
    n = F.count_distinct("month").alias("n")
    bad = series.groupBy(*keys, "year").agg(n).where(F.col("n") != months)
    if not bad.isEmpty():
        raise ValueError(f"years without {months} months: {bad.limit(5).collect()}")
    return series


def concat_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows; where keys repeat those of the earlier frame win."""
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn("_src", F.lit(i))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy(*keys).orderBy("_src")
    return out.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row", "_src")
