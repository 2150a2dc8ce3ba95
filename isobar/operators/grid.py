"""Grid operators on long cell tables (one row for each coordinate tuple).

Reductions are joins with a weight table and ``SUM(product)``; weights along a
level axis come from ``lead``/``lag`` inside a column of cells, so that a whole
column is the largest group that any operator here needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import G, KM_PER_DEGREE, col

# --- slices -------------------------------------------------------------------


def box(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Closed box; ``lat`` in either order; ``lon`` from high to low wraps around."""
    low, high = sorted(lat)
    east = F.col(lon_col).between(*lon) if lon[0] <= lon[1] else (F.col(lon_col) >= lon[0]) | (F.col(lon_col) <= lon[1])
    return cells.where(F.col(lat_col).between(low, high) & east)


def whole_days(cells: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """From the first moment of ``start`` to the last of ``end``."""
    return cells.where((F.col(ts) >= F.lit(start).cast("date")) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1)))


def box_join(cells: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cells in each region (region, lat0, lat1, lon0, lon1); a cell may be in several.

    The registry of regions is a short constant list and is broadcast.
    """
    inside = F.col(lat).between(F.col("lat0"), F.col("lat1")) & F.col(lon).between(F.col("lon0"), F.col("lon1"))
    return cells.join(F.broadcast(regions), inside).drop("lat0", "lat1", "lon0", "lon1")


def stride(cells: DataFrame, ts: str, hours: int) -> DataFrame:
    """Times thinned to one every ``hours``, by the cadence that the times show.

    The most frequent step between distinct times is the cadence; a coarser
    input is kept as it is.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    times = cells.select(F.col(ts)).distinct()
    by_time = Window.orderBy(ts)
    steps = times.withColumn("step", seconds - F.lag(seconds).over(by_time)).where("step is not null")
    mode = steps.groupBy("step").count().orderBy(F.desc("count"), "step").limit(1)
    every = mode.select(F.greatest(F.round(F.lit(hours * 3600) / F.col("step")), F.lit(1)).cast("int").alias("every"))
    kept = times.withColumn("row", F.row_number().over(by_time) - 1).crossJoin(F.broadcast(every)).where(F.col("row") % F.col("every") == 0)
    return cells.join(kept.select(ts), ts, "left_semi")


def merge_levels(cells: DataFrame, p: str, keys: list[str], values: list[str]) -> DataFrame:
    """Levels that differ by float noise as one: rounded to whole Pa, values averaged."""
    return cells.groupBy(*keys, F.round(F.col(p)).alias(p)).agg(*[F.avg(v).alias(v) for v in values])


# --- weights ------------------------------------------------------------------


def trapezoid_weights(cells: DataFrame, column: list[str], p: str = "p") -> DataFrame:
    """Adds ``w``: half the distance between the neighbouring levels of the column, over g."""
    by = Window.partitionBy(*column).orderBy(p)
    below, above = F.lag(p).over(by), F.lead(p).over(by)
    return cells.withColumn("w", (F.coalesce(F.col(p) - below, F.lit(0.0)) + F.coalesce(above - F.col(p), F.lit(0.0))) / (2 * G))


def layer_weights(cells: DataFrame, column: list[str], p: str = "p", ps: str = "ps") -> DataFrame:
    """Adds ``w`` as above over the levels with p <= ps, the lowest reaching down to ps.

    Levels below ground weigh 0; so does a column without any level above it.
    """
    above_ground = F.col(p) <= F.col(ps)
    inner = F.when(above_ground, F.col(p))
    by = Window.partitionBy(*column).orderBy(p)
    last = F.max(inner).over(Window.partitionBy(*column))
    down = F.coalesce(inner - F.lag(inner).over(by), F.lit(0.0))
    up = F.coalesce(F.lead(inner).over(by) - inner, F.lit(0.0))
    ground = F.when(F.col(p) == last, 2 * (F.col(ps) - F.col(p))).otherwise(0.0)
    return cells.withColumn("w", F.when(above_ground, (down + up + ground) / (2 * G)).otherwise(0.0))


def vertical_integral(cells: DataFrame, column: list[str], p: str = "p", q: str = "q", u: str = "u", v: str = "v", sign: int = 1) -> DataFrame:
    """Moisture transport and content of each column: ivt_u, ivt_v, ivt, iwv.

    ``sign`` -1 gives the flipped components of the feature table.
    """
    w = trapezoid_weights(cells, column, p)
    sums = w.groupBy(*column).agg(
        (sign * F.sum(F.col(q) * F.col(u) * F.col("w"))).alias("ivt_u"),
        (sign * F.sum(F.col(q) * F.col(v) * F.col("w"))).alias("ivt_v"),
        F.sum(F.col(q) * F.col("w")).alias("iwv"),
    )
    return sums.withColumn("ivt", F.hypot("ivt_u", "ivt_v"))


def weighted_mean(x, w) -> Column:
    """Mean of the x that aren't null, weighted by w."""
    x, w = col(x), col(w)
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def unit_weights(cells: DataFrame, group: list[str], weight: Column, valid: Column | None = None) -> DataFrame:
    """Adds ``aw``: weights that sum to 1 in each group, 0 where ``valid`` isn't true."""
    own = F.when(F.coalesce(valid, F.lit(False)), weight).otherwise(0.0) if valid is not None else weight
    return cells.withColumn("aw", F.try_divide(own, F.sum(own).over(Window.partitionBy(*group))))


def active_mean(cells: DataFrame, group: list[str], value: str, ref: str, share: float = 0.6) -> DataFrame:
    """Mean of ``value`` weighted by ``ref`` where ref exceeds its own percentile in the group."""
    limits = cells.groupBy(*group).agg(F.percentile(ref, F.lit(share)).alias("_limit"))
    both = cells.join(limits, group)
    return both.groupBy(*group).agg(weighted_mean(value, F.when(F.col(ref) > F.col("_limit"), F.col(ref)).otherwise(0.0)).alias(f"{value}_active"))


def spacing(values: DataFrame, axis: str) -> DataFrame:
    """One row: the mean distance of the axis's distinct values."""
    distinct = values.select(axis).distinct()
    return distinct.agg(F.try_divide(F.max(axis) - F.min(axis), F.count(axis) - 1).alias(f"d_{axis}"))


def cell_area(lat, dlat, dlon) -> Column:
    """Square kilometres of a cell on the sphere's plane at its latitude."""
    return col(dlat) * KM_PER_DEGREE * col(dlon) * KM_PER_DEGREE * F.cos(F.radians(col(lat)))


#: Pressure thickness in Pa of three fixed levels (250, 500, 850 hPa) by the trapezoid rule (fixed values).
THREE_LEVELS = (12500.0, 30000.0, 17500.0)


def three_level_integral(cells: DataFrame, keys: list[str], level: str, places: dict[float, int], value: str) -> DataFrame:
    """Mass-weighted integral over three fixed levels; keys that lack a level are left out.

    places: {level: its place in ``THREE_LEVELS``}; repeated cells of a key and
    level count with their mean.
    """
    weight = F.coalesce(*[F.when(F.col(level) == p, F.lit(THREE_LEVELS[i])) for p, i in places.items()])
    means = cells.where(F.col(level).isin(*places)).groupBy(*keys, level).agg(F.avg(value).alias(value))
    out = means.groupBy(*keys).agg((F.sum(F.col(value) * weight) / G).alias(value), F.count(value).alias("_n"))
    return out.where(F.col("_n") == len(places)).drop("_n")


# --- climatology --------------------------------------------------------------


def climatology(cells: DataFrame, keys: list[str], value: str, name: str = "clim") -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg(value).alias(name))


def quantile_climatology(cells: DataFrame, keys: list[str], value: str, q: float = 0.85, name: str = "clim") -> DataFrame:
    """Exact quantile with linear interpolation for each group; one group is one cell and month."""
    return cells.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias(name))


def anomaly(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``anom`` and ``anom_norm`` (over the group's population deviation)."""
    by = Window.partitionBy(*keys)
    a = F.col(value) - F.avg(value).over(by)
    return cells.withColumn("anom", a).withColumn("anom_norm", F.try_divide(F.col(value) - F.avg(value).over(by), F.stddev_pop(value).over(by)))


def threshold(cells: DataFrame, clim: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """Adds ``limit`` (climatology, at least ``floor``) and ``exceeds`` (strictly above it)."""
    both = cells.join(clim, keys, "left")
    limit = F.greatest(F.coalesce(F.col("clim"), F.lit(floor)), F.lit(floor))
    return both.withColumn("limit", limit).withColumn("exceeds", F.col(value) > limit).drop("clim")


# --- joins over coordinates ---------------------------------------------------


def merge_override(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on coordinates; where both sides have a column the left's value wins."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    right = b
    for c in shared:
        right = right.withColumnRenamed(c, f"_right_{c}")
    both = a.join(right, keys, "full")
    out = [F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) if c in shared else F.col(c) for c in a.columns]
    return both.select(*out, *[c for c in b.columns if c not in a.columns])


def nearest(left: DataFrame, right: DataFrame, on: str, value: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """For each left row the right ``value`` nearest in ``on`` (numbers), within ``tolerance``.

    Both sides are cut into bins of the tolerance's width; a left row meets the
    bins beside its own, so that the join is on equal bins.  Ties go to the
    smaller coordinate.  Left rows without a partner keep null.
    """
    keys = keys or []
    bins = F.floor(F.col(on) / tolerance)
    asked = left.withColumn("_id", F.struct(*left.columns)).withColumn("_bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    known = right.select(*keys, F.col(on).alias("_on"), F.col(value).alias("_value")).withColumn("_bin", F.floor(F.col("_on") / tolerance))
    near = asked.join(known, [*keys, "_bin"]).where(F.abs(F.col(on) - F.col("_on")) <= tolerance)
    best = near.groupBy("_id").agg(F.min_by(F.struct("_value", "_on"), F.struct(F.abs(F.col(on) - F.col("_on")), F.col("_on"))).alias("_best"))
    out = left.withColumn("_id", F.struct(*left.columns)).join(best, "_id", "left")
    return out.select(*left.columns, F.col("_best._value").alias(value), F.col("_best._on").alias(f"nearest_{on}"))


def nearest_axis(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(target, source) coordinates along one axis, each target with its nearest source.

    Axes are short (a grid's latitudes or longitudes) and are compared outright.
    Ties go to the smaller coordinate; there is no tolerance.
    """
    a = target.select(F.col(axis).alias("target")).distinct()
    b = F.broadcast(source.select(F.col(axis).alias("source")).distinct())
    near = a.join(b, F.col("source").isNotNull())
    return near.groupBy("target").agg(F.min_by("source", F.struct(F.abs(F.col("target") - F.col("source")), F.col("source"))).alias("source"))


def brackets(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(target, source, weight): the one or two source coordinates around each target, linear weights.

    Targets outside of the source axis get none.
    """
    a = target.select(F.col(axis).alias("target")).distinct()
    by = Window.orderBy("low")
    spans = source.select(F.col(axis).alias("low")).distinct().withColumn("high", F.lead("low").over(by))
    spans = F.broadcast(spans.withColumn("high", F.coalesce("high", "low")))
    inside = (F.col("target") >= F.col("low")) & ((F.col("target") < F.col("high")) | ((F.col("low") == F.col("high")) & (F.col("target") == F.col("low"))))
    found = a.join(spans, inside)
    share = F.coalesce(F.try_divide(F.col("target") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    ends = F.array(F.struct(F.col("low").alias("source"), (1 - share).alias("weight")), F.struct(F.col("high").alias("source"), share.alias("weight")))
    return found.select("target", F.inline(ends)).where("weight > 0")


def bilinear(cells: DataFrame, target: DataFrame, y: str, x: str, value: str, keys: list[str]) -> DataFrame:
    """Values at each target (y, x) from the four source cells around it, for each of ``keys``."""
    wy = brackets(cells, target, y).select(F.col("target").alias("_ty"), F.col("source").alias(y), F.col("weight").alias("_wy"))
    wx = brackets(cells, target, x).select(F.col("target").alias("_tx"), F.col("source").alias(x), F.col("weight").alias("_wx"))
    four = cells.join(F.broadcast(wy), y).join(F.broadcast(wx), x)
    out = four.groupBy(*keys, F.col("_ty").alias(y), F.col("_tx").alias(x))
    return out.agg(F.sum(F.col(value) * F.col("_wy") * F.col("_wx")).alias(value), F.sum(F.col("_wy") * F.col("_wx")).alias("_sum")).where("_sum > 1 - 1e-9").drop("_sum")


def overlap(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """(target, source, share): how much of each target interval a source interval covers.

    Both frames have ``{axis}_lo`` and ``{axis}_hi``, the cells' bounds.
    """
    lo, hi = f"{axis}_lo", f"{axis}_hi"
    a = target.select(F.col(lo).alias("_alo"), F.col(hi).alias("_ahi")).distinct()
    b = F.broadcast(source.select(F.col(lo).alias("_blo"), F.col(hi).alias("_bhi")).distinct())
    both = a.join(b, (F.col("_blo") < F.col("_ahi")) & (F.col("_bhi") > F.col("_alo")))
    width = F.least("_ahi", "_bhi") - F.greatest("_alo", "_blo")
    return both.select(F.col("_alo").alias("target"), F.col("_blo").alias("source"), (width / (F.col("_ahi") - F.col("_alo"))).alias("share"))


def conservative(cells: DataFrame, target: DataFrame, y: str, x: str, value: str, keys: list[str]) -> DataFrame:
    """Area-weighted regrid: for each target cell the mean of the source cells by overlap.

    Cells are given by their bounds; a target is named by its lower ones.
    """
    wy = overlap(cells, target, y).select(F.col("target").alias("_ty"), F.col("source").alias(f"{y}_lo"), F.col("share").alias("_wy"))
    wx = overlap(cells, target, x).select(F.col("target").alias("_tx"), F.col("source").alias(f"{x}_lo"), F.col("share").alias("_wx"))
    both = cells.join(F.broadcast(wy), f"{y}_lo").join(F.broadcast(wx), f"{x}_lo").where(F.col(value).isNotNull())
    w = F.col("_wy") * F.col("_wx")
    return both.groupBy(*keys, F.col("_ty").alias(f"{y}_lo"), F.col("_tx").alias(f"{x}_lo")).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias(value))


def outside_buffer(rows: DataFrame, blocks: DataFrame, buffer: float, half: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows that are not closer than ``buffer`` degrees to the edge of any block.

    Blocks (block_lat, block_lon) are centres of squares ``2 * half`` wide; the
    distance is Euclidean and 0 inside.  A row meets only the blocks that it
    could be near to: those are entered under the indices of all squares that
    they reach, and joined on the row's own.  Rows without a place stay.
    """
    size = max(2 * half, buffer, 1e-9)
    reach = math.ceil((half + buffer) / size)
    index = lambda c: F.floor(F.col(c) / size).cast("long")
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    entered = blocks.select("block_lat", "block_lon").distinct().withColumn("_di", steps).withColumn("_dj", steps)
    entered = entered.select("block_lat", "block_lon", (index("block_lat") + F.col("_di")).alias("_bi"), (index("block_lon") + F.col("_dj")).alias("_bj"))
    dy = F.greatest(F.abs(F.col(lat) - F.col("block_lat")) - half, F.lit(0.0))
    dx = F.greatest(F.abs(F.col(lon) - F.col("block_lon")) - half, F.lit(0.0))
    return rows.join(entered, (index(lat) == F.col("_bi")) & (index(lon) == F.col("_bj")) & (F.sqrt(dy * dy + dx * dx) < buffer), "left_anti")


# --- resampling ---------------------------------------------------------------


def tumbling_sum(cells: DataFrame, ts: str, value: str, keys: list[str], hours: int = 6) -> DataFrame:
    start = F.window(F.col(ts), f"{hours} hours")["start"]
    return cells.groupBy(*keys, start.alias("start")).agg(F.sum(value).alias(value))


def interval_join(events: DataFrame, series: DataFrame, keys: list[str], ts: str, start: str, end: str, hours: int = 6) -> DataFrame:
    """Series rows of an event's cells in the closed span from start to end plus ``hours``.

    Both sides carry the day, so that the join is on equal keys and days and
    only then compares times.
    """
    last = F.col(end) + F.expr(f"interval {hours} hours")
    days = events.withColumn("_last", last).withColumn("_day", F.explode(F.sequence(F.col(start).cast("date"), F.col("_last").cast("date"))))
    rows = series.withColumn("_day", F.col(ts).cast("date"))
    return days.join(rows, [*keys, "_day"]).where(F.col(ts).between(F.col(start), F.col("_last"))).drop("_day", "_last")
