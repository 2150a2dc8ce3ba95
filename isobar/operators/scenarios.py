"""Scoring of climate scenarios: feature matrix, intensity by fold means, events, rainfall quantiles.

``run`` is the whole way of one protocol.  ``direct`` takes a scenario's own
features; ``delta`` takes the observed ones plus the scenario's change of monthly
climatology (``delta_features``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.scalars import wavelike_day
from isobar.operators import components, events, trees

PHYSICS = ["ivt", "ivt_u", "ivt_v", "theta_e_850", "pv_250", "eady_growth_rate"]
#: Columns of the intensity models, in the order that they are trained and scored in.
STAGE1 = [*PHYSICS, "lat_deg", "doy_sin", "doy_cos"]
#: Columns of the rainfall models.
STAGE2 = ["mean_intensity", "max_intensity", "footprint_area_km2", "duration_hours", "landfall_lat", "mean_elev_m", "max_elev_m", "std_elev_m", "land_fraction"]
QUANTILES = {0.05: "precip_pred_q05_mm", 0.5: "precip_pred_q50_mm", 0.95: "precip_pred_q95_mm"}


def stage1_matrix(cells: DataFrame, ts: str = "ts", lat: str = "lat", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all other columns) and the nine columns of ``STAGE1`` in single precision.

    Fields that are missing stay null: they follow the right branches of trees.
    """
    sine, cosine = wavelike_day(ts)
    own = {c: F.col(c) for c in PHYSICS} | {"lat_deg": F.col(lat), "doy_sin": sine, "doy_cos": cosine}
    kept = [c for c in cells.columns if c not in own] if keep is None else keep
    return cells.select(*kept, *[own[c].cast("float").alias(c) for c in STAGE1])


def monthly_climatology(cells: DataFrame, keys: list[str], month: str, fields: list[str]) -> DataFrame:
    return cells.groupBy(*keys, month).agg(*[F.avg(c).alias(c) for c in fields])


def delta_features(observed: DataFrame, past: DataFrame, future: DataFrame, keys: list[str], month: str, fields: list[str] = PHYSICS) -> DataFrame:
    """``observed`` plus the change from ``past`` to ``future`` of each place's monthly mean.

    The change has a row a place and month, whatever the length of the periods.
    Places and months that a period lacks have no change and are left out.
    """
    a, b = (monthly_climatology(p, keys, month, fields) for p in (past, future))
    change = a.alias("a").join(b.alias("b"), [*keys, month]).select(*keys, month, *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"_d_{c}") for c in fields])
    out = observed.join(change, [*keys, month])
    return out.select(*[(F.col(c) + F.col(f"_d_{c}")).alias(c) if c in fields else F.col(c) for c in observed.columns])


def predict_intensity(matrix: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``ar_intensity``: the mean over the folds' models, in single precision."""
    scored = trees.score_fold_mean(matrix, models, {None: "ar_intensity"})
    return scored.withColumn("ar_intensity", F.col("ar_intensity").cast("float"))


def score_events(found: DataFrame, models: DataFrame, names: dict[float, str] = QUANTILES) -> DataFrame:
    """Adds a column for each quantile: the mean over the folds' models of it."""
    single = found.select(*found.columns, *[F.col(c).cast("float").alias(f"_f_{c}") for c in STAGE2])
    own = models.withColumn("features", F.array(*[F.lit(f"_f_{c}") for c in STAGE2]))
    return trees.score_fold_mean(single, own, names).select(*found.columns, *names.values())


def run(cells: DataFrame, stage1: DataFrame, stage2: DataFrame, terrain: DataFrame, keys: list[str], threshold: float, dlat: float, dlon: float) -> DataFrame:
    """One row an event of each cube of ``keys``, with its features and its rainfall quantiles.

    cells: keys, it, iy, ix (steps and places as integers), ts, lat, lon and the
    physics; terrain: lat, lon, elevation_m, land_sea_mask.  Cells above
    ``threshold`` that touch in space or time (26 neighbours) are an event;
    events of one voxel are left out, as are those off the terrain's cells of
    their features only (their terrain is null).
    """
    scored = predict_intensity(stage1_matrix(cells), stage1)
    voxels = scored.where(F.col("ar_intensity") > threshold).withColumnRenamed("ar_intensity", "intensity")
    parts = components.components_3d(voxels, keys)
    numbered = events.number_events(voxels.join(parts, [*keys, "it", "iy", "ix"]), keys)
    land = terrain.select("lat", "lon", "land_sea_mask")
    numbered = numbered.join(land, ["lat", "lon"], "left").withColumn("land_sea_mask", F.coalesce("land_sea_mask", F.lit(0.0)))
    table = events.event_table(numbered, keys, dlat, dlon)
    table = events.attach_features(table, numbered, PHYSICS, keys)
    table = events.attach_terrain(table, numbered, terrain, keys)
    return score_events(table, stage2)
