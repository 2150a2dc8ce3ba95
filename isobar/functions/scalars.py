"""Column functions: dates, longitudes, names, bands, and moist thermodynamics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Physical constants (fixed values): gravity, gas constant and heat capacity of dry air, their ratio to vapour's.
G, RD, CP, EPS = 9.80665, 287.04749, 1004.6662, 0.62194
OMEGA, EARTH_RADIUS = 7.292115e-5, 6371008.7714
KM_PER_DEGREE = 111.0

#: Months of each season by number; DJF holds months of one calendar year (fixed values).
SEASONS = {"ALL": tuple(range(1, 13)), "DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def edge(x, digits: int = 6) -> Column:
    """A computed number as it is reported: rounded with a small bias, so that ties go one way."""
    return F.round(col(x) + F.lit(1e-9), digits)


def scaled_round(x, digits: int) -> Column:
    """A double rounded as SQL engines in C++ do: times a power of ten, half away from zero, over that power.

    Spark's own ``round`` goes by the shortest decimal text instead, so the two
    part where a value is a tie but for the last bits of its sum.
    """
    scale = F.lit(10.0**digits)
    return F.round(col(x) * scale, 0) / scale


def lon360(lon) -> Column:
    return F.pmod(col(lon), F.lit(360.0))


def lon180(lon) -> Column:
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def wavelike_day(ts, offset: int = 0) -> tuple[Column, Column]:
    """Sine and cosine of 2 pi (day of year - offset) / 365.25."""
    angle = F.lit(2 * math.pi / 365.25) * (F.dayofyear(col(ts)) - offset)
    return F.sin(angle), F.cos(angle)


def in_season(month, season: str) -> Column:
    return col(month).isin(*SEASONS[season])


def region_key(name) -> Column:
    """Lower-case ASCII letters and digits of a name."""
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]", "")


def year_span(text) -> tuple[Column, Column]:
    """First and last year of "1980-2014" or "1998"."""
    parts = F.split(col(text), "-")
    first = F.get(parts, F.lit(0)).cast("int")
    return first, F.coalesce(F.get(parts, F.lit(1)).cast("int"), first)


def right_closed_band(x, edges: list[float], labels: list[str]) -> Column:
    """Label of (edge, next edge]; the lowest edge is included; outside null."""
    x, out = col(x), None
    for i, label in enumerate(labels):
        low = x >= edges[i] if i == 0 else x > edges[i]
        test = low & (x <= edges[i + 1])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def no_nan(x) -> Column:
    """NaN as null, which Spark's aggregates skip."""
    return F.when(~F.isnan(col(x)), col(x))


def signed(x, digits: int = 1) -> Column:
    """A number with its sign, and a dash for null."""
    return F.when(col(x).isNotNull(), F.format_string(f"%+.{digits}f", col(x))).otherwise("-")


def star(p, level: float = 0.05) -> Column:
    return F.when(col(p) < level, "*").otherwise("")


def ratio(a, b) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(col(a), col(b))


# --- thermodynamics -----------------------------------------------------------


def saturation_pressure(celsius) -> Column:
    """Saturation vapour pressure in Pa after Bolton (1980)."""
    t = col(celsius)
    return F.lit(611.2) * F.exp(F.lit(17.67) * t / (t + 243.5))


def vapour_pressure(pressure_pa, q) -> Column:
    """From specific humidity."""
    w = col(q) / (F.lit(1.0) - col(q))
    return col(pressure_pa) * w / (w + EPS)


def dewpoint(pressure_pa, q) -> Column:
    """Dewpoint in Celsius: Bolton's vapour pressure inverted."""
    ratio_ = F.log(F.greatest(vapour_pressure(pressure_pa, q), F.lit(1e-6)) / 611.2)
    return F.lit(243.5) * ratio_ / (F.lit(17.67) - ratio_)


def potential_temperature(pressure_pa, kelvin) -> Column:
    return col(kelvin) * F.pow(F.lit(100000.0) / col(pressure_pa), F.lit(RD / CP))


def equivalent_potential_temperature(pressure_pa, kelvin, q) -> Column:
    """Theta-e after Bolton (1980), equations 15, 24 and 39."""
    p, t = col(pressure_pa), col(kelvin)
    e = vapour_pressure(pressure_pa, q)
    td = dewpoint(pressure_pa, q) + 273.15
    r = F.lit(EPS) * e / (p - e)
    tl = F.lit(56.0) + F.lit(1.0) / (F.lit(1.0) / (td - 56.0) + F.log(t / td) / 800.0)
    dry = t * F.pow(F.lit(100000.0) / (p - e), F.lit(RD / CP)) * F.pow(t / tl, F.lit(0.28) * r)
    return dry * F.exp((F.lit(3036.0) / tl - 1.78) * r * (F.lit(1.0) + F.lit(0.448) * r))


def coriolis(lat) -> Column:
    return F.lit(2 * OMEGA) * F.sin(F.radians(col(lat)))


def wmaxshear(cape, u_high, v_high, u_low, v_low) -> Column:
    """sqrt(2 CAPE) times the wind difference; negative CAPE counts as 0."""
    return F.sqrt(F.lit(2.0) * F.greatest(col(cape), F.lit(0.0))) * F.hypot(col(u_high) - col(u_low), col(v_high) - col(v_low))
