"""S2 cells: points to cells, parents, and rectangle covers at one level, on arrays.

Cells are 64-bit ids in two's complement: face, Hilbert position, and a marker bit
below the position. A rectangle's cover at a level is found face by face from
exact bounds of the projected coordinates, so no cell that the rectangle touches
is missing; a few that it does not touch may be there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.schema import BBox
from cartulary.session import ship

MAX_LEVEL = 30
# The published Hilbert curve tables (quadrant to position by orientation; orientation change by position).
IJ_TO_POS = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 0, 1], [2, 1, 3, 0]], np.int64)
ORIENTATION = np.array([1, 0, 0, 3], np.int64)
#: Cells that are made at once.
CELLS = 1 << 20


def _st(u: np.ndarray) -> np.ndarray:
    """The quadratic projection from [-1, 1] to [0, 1]."""
    return np.where(u >= 0, 0.5 * np.sqrt(np.maximum(1 + 3 * u, 0)), 1 - 0.5 * np.sqrt(np.maximum(1 - 3 * u, 0)))


def _ids(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
    """Ids of cells by their column and row at a level."""
    turn, pos = face & 1, np.zeros(len(i), np.int64)
    for k in range(level - 1, -1, -1):
        p = IJ_TO_POS[turn, (i >> k & 1) << 1 | (j >> k & 1)]
        pos = pos << 2 | p
        turn = turn ^ ORIENTATION[p]
    shift = 2 * (MAX_LEVEL - level) + 1
    return (face.astype(np.uint64) << np.uint64(61) | pos.astype(np.uint64) << np.uint64(shift) | np.uint64(1 << (shift - 1))).view(np.int64)


def cell_of(lon, lat, level: int = MAX_LEVEL) -> np.ndarray:
    """The cells of points given in degrees."""
    lam, phi = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    xyz = np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])
    axis = np.abs(xyz).argmax(0)
    main = np.take_along_axis(xyz, axis[None], 0)[0]
    face = (axis + 3 * (main < 0)).astype(np.int64)
    x, y, z = xyz
    u = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [y, -x, -x, z, z], -y) / main
    v = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [z, z, -y, y, -x], -x) / main
    size = 1 << MAX_LEVEL
    i, j = (np.clip(np.floor(_st(w) * size), 0, size - 1).astype(np.int64) for w in (u, v))
    return parent(_ids(face, i, j, MAX_LEVEL), level)


def parent(cell, level: int) -> np.ndarray:
    """The ancestors of cells at a level."""
    low = np.uint64(1 << 2 * (MAX_LEVEL - level))
    return (np.asarray(cell, np.int64).view(np.uint64) & ~(low - np.uint64(1)) & ~low | low).view(np.int64)


def parent_column(cell: Column, level: int) -> Column:
    """parent() as a column expression."""
    low = 1 << 2 * (MAX_LEVEL - level)
    return cell.bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


def _range(lo, hi, reach):
    """Whether angles from lo to hi, in degrees, hold some reach + 360 k."""
    return np.floor((hi - reach) / 360) >= np.ceil((lo - reach) / 360)


def _products(a_lo, a_hi, b_lo, b_hi):
    four = np.stack([a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi])
    return four.min(0), four.max(0)


def _bounds(face: int, x0, y0, x1, y1):
    """Bounds of u and v on a face of rectangles in degrees, and whether they meet the face."""
    if face in (2, 5):
        sign = 1 if face == 2 else -1
        lo, hi = (y0, y1) if face == 2 else (-y1, -y0)  # latitude towards the face's pole
        meets = hi > 35
        lo = np.clip(np.maximum(lo, 35), None, 90)
        cot = np.tan(np.radians(90 - np.maximum(hi, lo))), np.tan(np.radians(90 - lo))
        trig = []
        for f, top, bottom in ((np.cos, 0, 180), (np.sin, 90, 270)):
            ends = np.stack([f(np.radians(x0)), f(np.radians(x1))])
            trig.append((np.where(_range(x0, x1, bottom), -1.0, ends.min(0)), np.where(_range(x0, x1, top), 1.0, ends.max(0))))
        (c0, c1), (s0, s1) = (_products(*cot, *t) for t in trig)
        # u, v are -cot cos, -cot sin at the north pole's face and cot sin, cot cos (of the positive cotangent) at the south's
        return (-c1, -c0, -s1, -s0, meets) if sign > 0 else (s0, s1, c0, c1, meets)
    centre = {0: 0, 1: 90, 3: 180, 4: -90}[face]
    low, high = x0 - centre, x1 - centre
    turn = 360 * np.round(-(low + high) / 720)
    low, high = low + turn, high + turn
    meets = (low <= 45.001) & (high >= -45.001)
    low, high = np.clip(low, -45.001, 45.001), np.clip(high, -45.001, 45.001)
    across = np.tan(np.radians(low)), np.tan(np.radians(high))
    far = 1 / np.cos(np.radians(np.maximum(np.abs(low), np.abs(high))))
    near = np.where((low <= 0) & (high >= 0), 1.0, 1 / np.cos(np.radians(np.minimum(np.abs(low), np.abs(high)))))
    tan = np.tan(np.radians(np.clip(y0, -89.9, 89.9))), np.tan(np.radians(np.clip(y1, -89.9, 89.9)))
    up = _products(*tan, near, far)
    return (*across, *up, meets) if face in (0, 1) else (-up[1], -up[0], *across, meets)


def cover_ranges(x0, y0, x1, y1, level: int):
    """Per face that rectangles touch: face, row of the rectangle, first and last i and j."""
    x0, y0, x1, y1 = (np.asarray(v, float) for v in (x0, y0, x1, y1))
    size, out = 1 << level, []
    for face in range(6):
        pieces = [(x0, x1, np.ones(len(x0), bool))]
        if face in (0, 1, 3, 4):  # a rectangle wider than half the globe can meet a face at both ends
            middle = (x0 + x1) / 2
            wide = x1 - x0 > 180
            pieces = [(x0, np.where(wide, middle, x1), np.ones(len(x0), bool)), (middle, x1, wide)]
        for a, b, live in pieces:
            u0, u1, v0, v1, meets = _bounds(face, a, y0, b, y1)
            pad = 1e-12
            meets = meets & live & (u0 <= 1 + pad) & (u1 >= -1 - pad) & (v0 <= 1 + pad) & (v1 >= -1 - pad)
            rows = np.flatnonzero(meets)
            if not len(rows):
                continue
            lims = []
            for w, side in ((u0, -pad), (u1, pad), (v0, -pad), (v1, pad)):
                s = _st(np.clip(w[rows], -1, 1)) + side
                lims.append(np.clip(np.floor(s * size), 0, size - 1).astype(np.int64))
            out.append((face, rows, *lims))
    return out


def cover(x0, y0, x1, y1, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of many rectangles: arrays of rectangle rows and ids, of bounded size each. A pair may come twice."""
    for face, rows, i0, i1, j0, j1 in cover_ranges(x0, y0, x1, y1, level):
        wide, high = i1 - i0 + 1, j1 - j0 + 1
        counts = wide * high
        ends = np.cumsum(counts)
        at = 0
        while at < int(ends[-1]):
            place = np.arange(at, min(at + CELLS, int(ends[-1])))
            own = np.searchsorted(ends, place, side="right")
            inside = place - (ends[own] - counts[own])
            i, j = i0[own] + inside // high[own], j0[own] + inside % high[own]
            yield rows[own], _ids(np.full(len(i), face, np.int64), i, j, level)
            at += CELLS


def count_cells(box: BBox, level: int) -> int:
    """How many cells the cover of a box has, without making them."""
    found = cover_ranges([box.min_x], [box.min_y], [box.max_x], [box.max_y], level)
    return int(sum(((i1 - i0 + 1) * (j1 - j0 + 1)).sum() for _, _, i0, i1, j0, j1 in found))


def cover_box(box: BBox, level: int) -> np.ndarray:
    parts = [ids for _, ids in cover([box.min_x], [box.min_y], [box.max_x], [box.max_y], level)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def auto_level(area: float, rounding: str = "half_even") -> int:
    """A level by area in square degrees; a box without area gets the finest."""
    if area <= 0:
        return MAX_LEVEL
    size = math.log10(area * 10000)
    return min(30, max(10, 30 - (round(size) if rounding == "half_even" else int(size))))


def auto_level_column(area: Column, rounding: str = "half_even") -> Column:
    size = F.log10(area * F.lit(10000.0))
    steps = F.rint(size).cast("int") if rounding == "half_even" else size.cast("int")
    return F.when(area > 0, F.least(F.lit(30), F.greatest(F.lit(10), 30 - steps))).otherwise(F.lit(MAX_LEVEL))


def effective_level(index_level: int, box: BBox) -> int:
    return min(index_level, auto_level(box.area))


def cell_column(lon: Column, lat: Column, level: int) -> Column:
    """The cell of a point, by an Arrow UDF."""

    @F.pandas_udf("long")
    def cells(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(cell_of(x.to_numpy(), y.to_numpy(), level))

    return cells(lon, lat)


def cells_of(features: DataFrame, level: int, key: str = "fid") -> DataFrame:
    """fid and cell, a row for every cell of a feature's box at the level."""
    ship(features.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("min_x", "min_y", "max_x", "max_y")]
            wide = box[2] - box[0] > 180  # only these can meet a face in two pieces and so a cell twice
            narrow = np.flatnonzero(~wide)
            for rows, ids in cover(*[b[narrow] for b in box], level):
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(narrow[rows])), pa.array(ids)], [key, "cell"])
            for i in np.flatnonzero(wide):
                ids = cover_box(BBox(*[float(b[i]) for b in box]), level)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(key)[i].as_py(), len(ids)), pa.int64()), pa.array(ids)], [key, "cell"])

    own = features.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return own.na.drop().mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField("cell", T.LongType())]))
