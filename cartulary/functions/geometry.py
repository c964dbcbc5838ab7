"""Column functions on coordinate arrays and boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.schema import GEOM_TYPES, BBox
from cartulary.session import ship

SIDES = ("min_x", "min_y", "max_x", "max_y")


def bbox_of(coords: Column | str) -> Column:
    """The bounding box of a coordinate array as a struct; an empty one gives zeros."""
    c = F.col(coords) if isinstance(coords, str) else coords
    zero = F.lit(0.0)
    xs, ys = F.transform(c, lambda p: p.x), F.transform(c, lambda p: p.y)
    parts = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.struct(*[F.coalesce(p, zero).alias(n) for p, n in zip(parts, SIDES, strict=True)])


def reorder_envelope(min_x: Column, max_x: Column, min_y: Column, max_y: Column) -> Column:
    """An envelope in the order of GDAL as a box struct."""
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def center_of(prefix: str = "") -> tuple[Column, Column]:
    x = (F.col(f"{prefix}min_x") + F.col(f"{prefix}max_x")) / 2.0
    return x, (F.col(f"{prefix}min_y") + F.col(f"{prefix}max_y")) / 2.0


def is_valid_bbox() -> Column:
    return (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y"))


def intersects(box: BBox) -> Column:
    """Closed rectangle intersection: touching counts. Four comparisons that Parquet scans push down."""
    return (F.col("min_x") <= box.max_x) & (F.col("max_x") >= box.min_x) & (F.col("min_y") <= box.max_y) & (F.col("max_y") >= box.min_y)


def geometry_code(name: Column) -> Column:
    """The code of a geometry type name; 25D and Z forms are their 2D ones, unknown names are points."""
    flat = F.upper(F.regexp_replace(name, r"(?i)^wkb|25D$|[ _]?ZM?$|[ _]?M$", ""))
    flat = F.regexp_replace(flat, "STRING$", "")
    out = F.lit(GEOM_TYPES["POINT"])
    for known, code in GEOM_TYPES.items():
        out = F.when(flat == known, code).otherwise(out)
    return F.coalesce(out, F.lit(GEOM_TYPES["POINT"]))


def geometry_name(code: Column) -> Column:
    out = F.lit("POINT")
    for name, c in GEOM_TYPES.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def flatten_parts(geom_type: Column, parts: Column) -> Column:
    """Coordinates of a geometry given as parts of rings of points: of every polygon the exterior ring, parts joined in order.

    Points and lines have their points in the first ring of each part.
    """
    known = F.flatten(F.transform(parts, lambda rings: F.coalesce(F.get(rings, F.lit(0)), F.array().cast("array<struct<x:double,y:double>>"))))
    return F.when(geom_type.between(0, 5), known).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def stringify(fields: dict[str, Column]) -> Column:
    """Attributes as a map of strings in field order; null fields are absent."""
    whole = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[c.cast("string") for c in fields.values()]))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def get_property(properties: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(properties, F.lit(key)), F.lit(default))


def pivot_properties(features: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Properties as typed columns, name to Spark type."""
    kept = [c for c in features.columns if c not in fields]
    return features.select(*kept, *[F.try_element_at("properties", F.lit(k)).try_cast(t).alias(k) for k, t in fields.items()])


def _touches(x: np.ndarray, y: np.ndarray, kind: int, box: BBox) -> bool:
    if ((x >= box.min_x) & (x <= box.max_x) & (y >= box.min_y) & (y <= box.max_y)).any():
        return True
    if kind in (0, 3) or len(x) < 2:
        return False
    # Liang-Barsky on all segments at once
    dx, dy = np.diff(x), np.diff(y)
    start, end = np.zeros(len(dx)), np.ones(len(dx))
    out = np.zeros(len(dx), bool)
    for p, q in ((-dx, x[:-1] - box.min_x), (dx, box.max_x - x[:-1]), (-dy, y[:-1] - box.min_y), (dy, box.max_y - y[:-1])):
        out |= (p == 0) & (q < 0)
        r = np.divide(q, p, out=np.zeros_like(q), where=p != 0)
        start = np.where(p < 0, np.maximum(start, r), start)
        end = np.where(p > 0, np.minimum(end, r), end)
    if (~out & (start <= end)).any():
        return True
    if kind not in (2, 5):
        return False
    above = (y[:-1] > box.min_y) != (y[1:] > box.min_y)
    crossing = np.divide(dx * (box.min_y - y[:-1]), dy, out=np.zeros_like(dx), where=dy != 0) + x[:-1]
    return bool((above & (box.min_x < crossing)).sum() % 2)


def rect_intersects(features: DataFrame, box: BBox) -> DataFrame:
    """Features whose true geometry meets the box: a vertex inside, a segment across, or the box inside a ring.

    The bounding boxes are compared first, in the scan; only what passes goes to Python.
    """
    ship(features.sparkSession)

    @F.pandas_udf("boolean")
    def touches(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys, kinds in parts:
            yield pd.Series([_touches(np.asarray(x, float), np.asarray(y, float), k, box) for x, y, k in zip(xs, ys, kinds, strict=True)], dtype=bool)

    near = features.where(intersects(box) & (F.size("coords") > 0))
    return near.where(touches(F.col("coords.x"), F.col("coords.y"), F.col("geom_type")))
