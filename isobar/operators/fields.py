"""Feature fields from pressure-level cells: columns and neighbourhoods.

A column's levels are gathered by conditional aggregates; horizontal derivatives
come from ``lag`` and ``lead`` along each axis, so that no slice is gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import EARTH_RADIUS, G, coriolis, equivalent_potential_temperature, potential_temperature
from isobar.operators.grid import vertical_integral


def at_level(value: str, level: float, name: str = "level") -> Column:
    return F.max(F.when(F.col(name) == level, F.col(value)))


def gradient(value: str, along: str, by: list[str], scale: Column) -> Column:
    """Second-order differences on an uneven axis, one-sided at its ends, over ``scale``."""
    w = Window.partitionBy(*by).orderBy(along)
    x0, x1, x2 = F.lag(along).over(w), F.col(along), F.lead(along).over(w)
    f0, f1, f2 = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    a, b = x1 - x0, x2 - x1
    middle = (f2 * a * a + f1 * (b * b - a * a) - f0 * b * b) / (a * b * (a + b))
    return F.coalesce(middle, F.try_divide(f2 - f1, b), F.try_divide(f1 - f0, a)) / scale


def theta_e_850(cells: DataFrame, column: list[str]) -> DataFrame:
    """Equivalent potential temperature at 850 hPa."""
    own = cells.where(F.col("level") == 850)
    return own.select(*column, equivalent_potential_temperature(F.lit(85000.0), "t", "q").alias("theta_e_850"))


def eady_growth_rate(cells: DataFrame, column: list[str]) -> DataFrame:
    """0.31 |f| |dV/dz| / N between 850 and 250 hPa; N from the mean of N2 over levels."""
    c = cells.withColumn("_th", potential_temperature(F.col("level") * 100, "t")).withColumn("_z", F.col("z") / G)
    c = c.withColumn("_n2", F.lit(G) * gradient("_th", "_z", column, F.col("_th")))
    out = c.groupBy(*column).agg(F.avg("_n2").alias("_n2"), *[at_level(v, p).alias(f"{v}{p}") for v in ("u", "v", "_z") for p in (850, 250)])
    shear = F.try_divide(F.hypot(F.col("u250") - F.col("u850"), F.col("v250") - F.col("v850")), F.abs(F.col("_z250") - F.col("_z850")))
    n = F.when(F.col("_n2") > 0, F.sqrt("_n2"))
    return out.select(*column, (F.lit(0.31) * F.abs(coriolis("lat")) * shear / n).alias("eady_growth_rate"))


def potential_vorticity(cells: DataFrame, slice_: list[str], level: float = 250) -> DataFrame:
    """Ertel's potential vorticity at ``level``: -g (f + vorticity) dtheta/dp and the tilting terms."""
    column = [*slice_, "lat", "lon"]
    c = cells.withColumn("_p", F.col("level") * 100.0).withColumn("_th", potential_temperature(F.col("level") * 100, "t"))
    one = F.lit(1.0)
    for name, value in (("_thp", "_th"), ("_up", "u"), ("_vp", "v")):
        c = c.withColumn(name, gradient(value, "_p", column, one))
    c = c.where(F.col("level") == level)
    dx = F.lit(EARTH_RADIUS * math.pi / 180) * F.cos(F.radians("lat"))
    dy = F.lit(EARTH_RADIUS * math.pi / 180)
    along_x, along_y = [*slice_, "lat"], [*slice_, "lon"]
    c = c.withColumn("_vx", gradient("v", "lon", along_x, dx)).withColumn("_uy", gradient("u", "lat", along_y, dy))
    c = c.withColumn("_tx", gradient("_th", "lon", along_x, dx)).withColumn("_ty", gradient("_th", "lat", along_y, dy))
    spin = F.col("_vx") - F.col("_uy") + F.col("u") * F.tan(F.radians("lat")) / EARTH_RADIUS
    pv = -G * (F.col("_thp") * (coriolis("lat") + spin) - F.col("_vp") * F.col("_tx") + F.col("_up") * F.col("_ty"))
    return c.select(*column, pv.alias("pv_250"))


def features(cells: DataFrame) -> DataFrame:
    """The feature table (ts, lat, lon, ivt, ivt_u, ivt_v, theta_e_850, pv_250, eady_growth_rate).

    ivt_u and ivt_v keep the sign of an integral that runs down the column.
    """
    column = ["ts", "lat", "lon"]
    pa = cells.withColumn("_pa", F.col("level") * 100.0)
    ivt = vertical_integral(pa, column, "_pa", sign=-1).drop("iwv")
    out = ivt.join(theta_e_850(cells, column), column, "left").join(potential_vorticity(cells, ["ts"]), column, "left").join(eady_growth_rate(cells, column), column, "left")
    return out.select(*column, "ivt", "ivt_u", "ivt_v", "theta_e_850", "pv_250", "eady_growth_rate")
