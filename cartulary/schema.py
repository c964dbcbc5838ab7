"""Canonical schemas, geometry type codes and query boxes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# Geometry type codes.
GEOM_TYPES = {"POINT": 0, "LINE": 1, "POLYGON": 2, "MULTIPOINT": 3, "MULTILINE": 4, "MULTIPOLYGON": 5}
GEOM_NAMES = {v: k for k, v in GEOM_TYPES.items()}

_D, _L, _I, _S, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


COORD = _struct(x=_D, y=_D)
BBOX = _struct(min_x=_D, min_y=_D, max_x=_D, max_y=_D)
PROPERTIES = T.MapType(_S, _S)
FEATURE_SCHEMA = _struct(fid=_L, geom_type=_I, coords=T.ArrayType(COORD), min_x=_D, min_y=_D, max_x=_D, max_y=_D, properties=PROPERTIES)
GEOM_SCHEMA = _struct(fid=_L, geom_type=_I, bbox=BBOX, coords_bin=_B, offset=_L)
ATTR_SCHEMA = _struct(fid=_L, properties=PROPERTIES)
ATTR_ENC_SCHEMA = _struct(fid=_L, pairs=T.ArrayType(_struct(key_id=_I, value_id=_I)), offset=_L)
POOL_SCHEMA = _struct(string_id=_I, value=_S)
OFFSET_SCHEMA = _struct(fid=_L, geom_offset=_L, attr_offset=_L)
BENCH_SCHEMA = _struct(
    index_type=_S, operation=_S, data_size=_L, avg_time_ms=_D, min_time_ms=_D, max_time_ms=_D, std_dev_ms=_D, result_count=_L, memory_usage_mb=_D, iterations=_I
)


@dataclass(frozen=True)
class BBox:
    """A closed lon/lat rectangle. Boxes across the antimeridian are refused."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def __post_init__(self):
        if not all(map(math.isfinite, self.astuple())):
            raise ValueError(f"box needs finite numbers: {self.astuple()}")
        if self.min_x > self.max_x or self.min_y > self.max_y:
            raise ValueError(f"box needs min <= max on both axes (boxes across the antimeridian are not supported): {self.astuple()}")

    def astuple(self) -> tuple[float, float, float, float]:
        return self.min_x, self.min_y, self.max_x, self.max_y

    @property
    def area(self) -> float:
        return (self.max_x - self.min_x) * (self.max_y - self.min_y)

    def expand(self, by: float) -> BBox:
        return BBox(self.min_x - by, self.min_y - by, self.max_x + by, self.max_y + by)


# The boxes of the benchmark workload and of the county test.
BOXES = {
    "small": BBox(103.2504, 26.4297, 103.3028, 26.4747),
    "medium": BBox(103.0, 26.0, 104.0, 27.0),
    "large": BBox(102.0, 25.0, 105.0, 28.0),
    "county": BBox(100.546875, 25.3125, 101.25, 26.015625),
}
