"""Event tables: from voxels to events, what is added to them, and period summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import wavelike_day
from isobar.operators.grid import cell_area, interval_join

STEP_HOURS = 6


def number_events(voxels: DataFrame, keys: list[str], part: str = "part", ranges: int = 1024) -> DataFrame:
    """Adds ``event_id``: 1, 2, ... within ``keys`` in the order of the integer ``part``.

    Only one row an event is ranked, inside ranges of ``part`` whose sizes are
    summed up, so that no task ranks all events of a cube.
    """
    ids = voxels.select(*keys, part).distinct()
    span = ids.groupBy(*keys).agg(F.min(part).alias("_low"), F.greatest(F.ceil((F.max(part) - F.min(part) + 1) / ranges), F.lit(1)).alias("_width"))
    dealt = ids.join(span, keys) if keys else ids.crossJoin(F.broadcast(span))
    dealt = dealt.select(*keys, part, F.floor((F.col(part) - F.col("_low")) / F.col("_width")).alias("_range"))
    sizes = dealt.groupBy(*keys, "_range").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(part))
    ranked = dealt.join(before, [*keys, "_range"]).select(*keys, part, (F.col("_before") + rank).cast("long").alias("event_id"))
    return voxels.join(ranked, [*keys, part])


def event_table(voxels: DataFrame, keys: list[str], dlat: float, dlon: float, land: str = "land_sea_mask") -> DataFrame:
    """One row an event of at least two voxels.

    voxels: keys, event_id, ts, lat, lon, intensity, land share.  The footprint is
    the set of distinct cells; its landfall is the mean of those on land.
    """
    ids = [*keys, "event_id"]
    core = voxels.groupBy(*ids).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.avg("intensity").alias("mean_intensity"),
        F.max("intensity").alias("max_intensity"),
        F.count(F.lit(1)).alias("_n"),
    )
    core = core.where("_n >= 2").withColumn("duration_hours", (F.unix_seconds(F.col("end_time").cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))) / 3600.0 + STEP_HOURS)
    return core.drop("_n").join(footprints(voxels, keys, dlat, dlon, land), ids)


def footprints(voxels: DataFrame, keys: list[str], dlat: float, dlon: float, land: str = "land_sea_mask") -> DataFrame:
    """Area of the distinct cells, and the mean place of those on land (null without any)."""
    ids = [*keys, "event_id"]
    cells = voxels.groupBy(*ids, "lat", "lon").agg(F.max(land).alias("_land"))
    on_land = lambda c: F.avg(F.when(F.col("_land") > 0.5, F.col(c)))
    return cells.groupBy(*ids).agg(F.sum(cell_area("lat", F.lit(dlat), F.lit(dlon))).alias("footprint_area_km2"), on_land("lat").alias("landfall_lat"), on_land("lon").alias("landfall_lon"))


def attach_features(events: DataFrame, voxels: DataFrame, features: list[str], keys: list[str], day_offset: int = 1) -> DataFrame:
    """Adds feature means over voxels, the mean of distinct latitudes, and the mean time's day of year.

    ``day_offset`` 1 counts the year's days from 0, 0 from 1.
    """
    ids = [*keys, "event_id"]
    means = voxels.groupBy(*ids).agg(*[F.avg(c).alias(c) for c in features])
    lat = voxels.select(*ids, "lat").distinct().groupBy(*ids).agg(F.avg("lat").alias("lat_deg"))
    times = voxels.select(*ids, "ts").distinct().groupBy(*ids).agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).alias("_mid"))
    sine, cosine = wavelike_day("_mid", day_offset)
    out = events.join(means, ids, "left").join(lat, ids, "left").join(times, ids, "left")
    return out.withColumn("doy_sin", sine).withColumn("doy_cos", cosine).drop("_mid")


def attach_terrain(events: DataFrame, voxels: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """Adds elevation statistics of the footprint and its land share; null for events without cells."""
    ids = [*keys, "event_id"]
    cells = voxels.select(*ids, "lat", "lon").distinct().join(static, ["lat", "lon"])
    stats = cells.groupBy(*ids).agg(F.avg("elevation_m").alias("mean_elev_m"), F.max("elevation_m").alias("max_elev_m"), F.stddev_pop("elevation_m").alias("std_elev_m"), F.avg((F.col("land_sea_mask") > 0.5).cast("double")).alias("land_fraction"))
    return events.join(stats, ids, "left")


def attach_precip(events: DataFrame, voxels: DataFrame, precip: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``precip_total_mm``: metres over the footprint's cells in the closed span
    from start to end plus six hours, summed, over the number of cells, times 1000."""
    ids = [*keys, "event_id"]
    cells = voxels.select(*ids, "lat", "lon").distinct()
    spans = cells.join(events.select(*ids, "start_time", "end_time"), ids)
    rows = interval_join(spans, precip, ["lat", "lon"], "ts", "start_time", "end_time", STEP_HOURS)
    sums = rows.groupBy(*ids).agg(F.sum("tp").alias("_sum"))
    n = spans.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("_n") * 1000.0
    return events.join(n, ids, "left").join(sums, ids, "left").withColumn("precip_total_mm", F.when(F.col("_n").isNotNull(), total)).drop("_n", "_sum")


def period_of(ts: str, periods: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the periods (period, start, end) whose whole days they lie in; a short table."""
    inside = (F.col(ts) >= F.col("start")) & (F.col(ts) < F.date_add("end", 1))
    return rows.join(F.broadcast(periods.select("period", F.col("start").cast("date"), F.col("end").cast("date"))), inside).drop("start", "end")


def period_summary(events: DataFrame) -> DataFrame:
    """Counts and means by period."""
    return events.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg("mean_intensity").alias("mean_intensity"),
        F.avg("max_intensity").alias("mean_max_intensity"),
        F.avg("footprint_area_km2").alias("mean_footprint_km2"),
        F.avg("duration_hours").alias("mean_duration_h"),
    )


def _poisson(key: np.ndarray, reps: int) -> np.ndarray:
    """Counts (rows, reps) with mean one, from hashes of the rows' keys and the replicate."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)])
    return np.searchsorted(np.cumsum(share), ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def period_bands(events: DataFrame, keys: list[str], reps: int = 1000, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Bootstrap bands by period of the mean intensity and duration over the events.

    A replicate takes each event as often as a hash of ``keys``, event_id and
    the replicate says (Poisson counts, mean one).  Each task sums by period
    and replicate, so that no resample is laid out or shuffled.
    """
    values = {"intensity": "mean_intensity", "duration": "duration_hours"}
    rows = events.select("period", F.xxhash64(*keys, "event_id").alias("_key"), *[F.col(c).cast("double").alias(v) for v, c in values.items()])
    kind = rows.schema["period"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        sums = {}
        for batch in batches:
            for period, part in batch.groupby("period"):
                held = sums.setdefault(period, np.zeros((2 * len(values), reps)))
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    times = _poisson(some["_key"].to_numpy(), reps)
                    x = some[list(values)].to_numpy(float)
                    held += np.concatenate([np.nan_to_num(x), ~np.isnan(x)], axis=1).T @ times
        for period, held in sums.items():
            yield pd.DataFrame({"period": period, "rep": np.arange(reps, dtype=np.int32)} | {f"{n}_{v}": x for (n, v), x in zip([(n, v) for n in "sn" for v in values], held, strict=True)})

    parts = rows.mapInPandas(run, f"period {kind}, rep int, " + ", ".join(f"{n}_{v} double" for n in "sn" for v in values))
    means = parts.groupBy("period", "rep").agg(*[F.try_divide(F.sum(f"s_{v}"), F.sum(f"n_{v}")).alias(v) for v in values])
    return means.groupBy("period").agg(*[F.percentile(v, F.lit(q)).alias(f"{v}_{name}") for v in values for name, q in (("q05", low), ("q95", high))])


def verdict(monotone: Column, separate: Column, any_separate: Column, change: Column, small: float = 5.0) -> Column:
    """INTENSIFIED where every step is up and the first and last bands don't overlap; FLAT where no two bands in a row are apart and the whole change is under ``small``; else MIXED."""
    return F.when(monotone & separate, "INTENSIFIED").when(~any_separate & (F.abs(change) < small), "FLAT").otherwise("MIXED")


def bands_separate(low_a, high_a, low_b, high_b) -> Column:
    """Whether two closed intervals have no common point."""
    return (low_b > high_a) | (low_a > high_b)


def delta_change(base: DataFrame, hist: DataFrame, future: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Baseline plus the change of the monthly climatology (both are short per cell and month)."""
    d = hist.select(*keys, *[F.col(v).alias(f"_h_{v}") for v in values]).join(future.select(*keys, *[F.col(v).alias(f"_f_{v}") for v in values]), keys)
    both = base.join(d, keys)
    for v in values:
        both = both.withColumn(v, F.col(v) + F.col(f"_f_{v}") - F.col(f"_h_{v}"))
    return both.select(*base.columns)
