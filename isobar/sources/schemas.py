"""Canonical tables."""

from __future__ import annotations

PL_CELLS = "ts timestamp_ntz, level double, lat double, lon double, u float, v float, t float, q float, z float"
SFC_CELLS = "ts timestamp_ntz, lat double, lon double, sp float, tp float"
STATIC_CELLS = "lat double, lon double, elevation_m double, land_sea_mask double"
FEATURES = "ts timestamp_ntz, lat double, lon double, ivt float, ivt_u float, ivt_v float, theta_e_850 float, pv_250 float, eady_growth_rate float"
EVENTS = "event_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, duration_hours double, mean_intensity double, max_intensity double, footprint_area_km2 double, landfall_lat double, landfall_lon double"
PERIOD_SUMMARY = "period_name string, n_events bigint, mean_intensity double, mean_max_intensity double, mean_footprint_km2 double, mean_duration_h double, intensity_q05 double, intensity_q95 double, duration_q05 double, duration_q95 double"
CORRIDOR_MONTHLY = "corridor string, year int, month int, p_pa double, iy int, ix int, q double, u double, v double, t double"
WINDOW_TERMS = "pair string, block int, corridor string, term string, point double, ci_lo double, ci_hi double, p double, pfdr double"
YEARLY_TERMS = "corridor string, season string, year int, term string, value double"
TRENDS = "corridor string, span string, term string, slope_per_decade double, pct_per_decade double, p double"
INDICES = "ts date, rnino34 double, pdo double, amv double, nao double, sam double, pna double"


def empty(spark, schema: str):
    """A typed frame without rows: what a step without results returns."""
    return spark.createDataFrame([], schema)
