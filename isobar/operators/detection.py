"""Elongated-object detection in single time slices.

A slice's candidate cells are labelled (eight neighbours); objects are kept by
size, length, shape and direction.  Slices are independent, so that the kernel
runs as one grouped function a slice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from isobar.functions.scalars import KM_PER_DEGREE
from isobar.operators.components import NEAR_2D, components_3d, label
from isobar.operators.events import number_events
from isobar.operators.grid import threshold
from isobar.session import materialize

#: Cells of an object, its length in km, length over width, and the widest angle to the transport (fixed values).
LEAST_CELLS, LEAST_KM, LEAST_RATIO, MOST_DEGREES = 5, 2000.0, 2.0, 45.0


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of 2-D points, counter-clockwise (Andrew's monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    sides = []
    for seq in (pts, pts[::-1]):
        side: list = []
        for p in seq:
            while len(side) > 1 and turn(side[-2], side[-1], p) <= 0:
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1])


def shape(lat: np.ndarray, lon: np.ndarray) -> tuple[float, float, np.ndarray] | None:
    """Length in km, length over width and main axis; None where the cells lie on a line."""
    mid = lat.mean()
    xy = np.column_stack([(lon - lon.mean()) * KM_PER_DEGREE * math.cos(math.radians(mid)), (lat - mid) * KM_PER_DEGREE])
    ring = hull(xy)
    if len(ring) < 3:
        return None
    nxt = np.roll(ring, -1, axis=0)
    area = abs(float((ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum())) / 2
    length = float(np.sqrt(((ring[:, None] - ring[None]) ** 2).sum(axis=2)).max())
    if area <= 0 or length <= 0:
        return None
    values, vectors = np.linalg.eigh(np.cov(xy.T))
    return length, length * length / area, vectors[:, int(np.argmax(values))]


def keep_objects(iy: np.ndarray, ix: np.ndarray, lat: np.ndarray, lon: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of a slice's candidate cells belong to an object that is kept."""
    kept = np.zeros(len(iy), bool)
    root = label(np.column_stack([iy, ix]).astype(np.int64), NEAR_2D)
    least = math.cos(math.radians(MOST_DEGREES))
    for first in np.unique(root):
        own = np.flatnonzero(root == first)
        if len(own) < LEAST_CELLS or (found := shape(lat[own], lon[own])) is None:
            continue
        length, ratio, axis = found
        if length < LEAST_KM or ratio < LEAST_RATIO:
            continue
        mean = np.array([np.nanmean(u[own]), np.nanmean(v[own])])
        size = float(np.hypot(*mean))
        if size > 0 and abs(float(axis @ mean)) / size >= least:
            kept[own] = True
    return kept


def filter_slices(cells: DataFrame, ts: str = "ts") -> DataFrame:
    """Candidate cells (ts, iy, ix, lat, lon, ivt_u, ivt_v) of kept objects, all their columns."""

    def run(rows):
        keep = keep_objects(*(rows[c].to_numpy() for c in ("iy", "ix")), *(rows[c].to_numpy(float) for c in ("lat", "lon", "ivt_u", "ivt_v")))
        return rows[keep]

    return cells.groupBy(ts).applyInPandas(run, cells.schema)


def detect(cells: DataFrame, clim: DataFrame, by: list[str], floor: float, ts: str = "ts") -> DataFrame:
    """Cells (as above, with ``by`` and ivt) over the climatology's limit, ``floor`` at least, that belong to objects that are kept."""
    over = threshold(cells, clim, by, "ivt", floor).where("exceeds")
    return filter_slices(over.select(*cells.columns), ts)


def detect_events(cells: DataFrame, clim: DataFrame, by: list[str], floor: float, ts: str = "ts", step: str = "it") -> DataFrame:
    """The cells of ``detect`` with the event_id of the event that they are part of.

    ``step`` numbers the slices; cells that touch in space or in time (26
    neighbours) are one event.  Events are numbered 1, 2, ... by their first
    cell in the order of time, row and column.
    """
    kept = materialize(detect(cells, clim, by, floor, ts), "objects")
    at = [step, "iy", "ix"]
    return kept.join(number_events(components_3d(kept, [], *at), []).drop("part"), at)
