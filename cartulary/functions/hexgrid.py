"""A planar grid of hexagons over degrees, with the resolutions and the covering rule of H3 but ids of its own.

A box's cells are those whose centre lies in it (center containment). A hexagon's
corners are size() away from its centre, so boxes that are widened by that much
on both sides share a cell whenever they meet; that is the default buffer.
Everything is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.schema import BBox

# The edge of a resolution 0 hexagon in kilometres, kilometres of a degree, the least buffer in degrees.
EDGE_0_KM, KM_PER_DEGREE, LEAST_BUFFER = 1107.712591, 111.195, 0.001
_SHIFT = 1 << 31


def size(resolution: int) -> float:
    """Centre to corner, in degrees."""
    if not 0 <= resolution <= 15:
        raise ValueError("resolution is 0 to 15")
    return EDGE_0_KM / KM_PER_DEGREE / math.sqrt(7) ** resolution


def buffer_of(resolution: int) -> float:
    return max(LEAST_BUFFER, size(resolution) * 1.000001)


def cell_id(q: Column, r: Column) -> Column:
    """Axial coordinates in one long."""
    return F.shiftleft(r.cast("long"), 32) + q.cast("long") + F.lit(_SHIFT)


def rows_of(min_y: Column, max_y: Column, resolution: int) -> Column:
    """Rows of hexagons whose centres lie in a range of latitudes, as an array (empty if none)."""
    step = 1.5 * size(resolution)
    first, last = F.ceil(min_y / F.lit(step)).cast("long"), F.floor(max_y / F.lit(step)).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def columns_of(min_x: Column, max_x: Column, row: Column, resolution: int) -> Column:
    """Columns of a row whose centres lie in a range of longitudes."""
    step = math.sqrt(3) * size(resolution)
    first = F.ceil(min_x / F.lit(step) - row / F.lit(2.0)).cast("long")
    last = F.floor(max_x / F.lit(step) - row / F.lit(2.0)).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def cell_of(lon: Column, lat: Column, resolution: int) -> Column:
    """The cell of a point, by rounding cube coordinates."""
    s = size(resolution)
    r = lat / F.lit(1.5 * s)
    q = lon / F.lit(math.sqrt(3) * s) - r / F.lit(2.0)
    t = -q - r
    rq, rr, rt = F.rint(q), F.rint(r), F.rint(t)
    dq, dr, dt = F.abs(rq - q), F.abs(rr - r), F.abs(rt - t)
    out_q = F.when((dq > dr) & (dq > dt), -rr - rt).otherwise(rq)
    out_r = F.when(~((dq > dr) & (dq > dt)) & (dr > dt), -rq - rt).otherwise(rr)
    return cell_id(out_q.cast("long"), out_r.cast("long"))


def count_cells(box: BBox, resolution: int) -> int:
    """About how many cells a box has."""
    s = size(resolution)
    return math.ceil((box.max_y - box.min_y) / (1.5 * s) + 1) * math.ceil((box.max_x - box.min_x) / (math.sqrt(3) * s) + 1)
