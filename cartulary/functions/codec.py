"""Coordinate codecs: delta quantisation as columns, and bytes by Arrow UDFs.

Modes of encode():
  adaptive   first point, then deltas behind a flag: 2 = float, 0 = short, 1 = int, rounded half to even
  truncated  as adaptive, but deltas pass through float, fractions are cut off and floats serve only huge deltas
  plain      first point and float deltas without a flag
  raw        a count and the points as doubles
An empty array is no bytes; a single point is its 16 bytes (in all modes but raw).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import ship

SHORT, INT, FLOAT = 0, 1, 2
# The least delta that a short or an int cannot hold.
SHORT_END, INT_END = 32767, 2147483647
MODES = ("adaptive", "truncated", "plain", "raw")
_KINDS = {SHORT: "<i2", INT: "<i4", FLOAT: "<f4"}


def flag_of(largest: Column) -> Column:
    """The adaptive codec's flag for the largest absolute delta."""
    return F.when(largest < 1.0, FLOAT).when(largest < SHORT_END, SHORT).when(largest < INT_END, INT).otherwise(FLOAT)


def deltas(coords: Column) -> Column:
    """Differences of neighbouring points."""
    n = F.size(coords)
    later, before = F.slice(coords, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(coords, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, before, lambda a, b: F.struct((a.x - b.x).alias("dx"), (a.y - b.y).alias("dy")))


def largest_delta(coords: Column) -> Column:
    sizes = F.transform(deltas(coords), lambda d: F.greatest(F.abs(d.dx), F.abs(d.dy)))
    return F.coalesce(F.array_max(sizes), F.lit(0.0))


def quantise(delta: Column, flag: Column) -> Column:
    """What a delta is after a round trip."""
    return F.when(flag == FLOAT, delta.cast("float").cast("double")).otherwise(F.rint(delta))


def quantised_vertices(vertices: DataFrame, fid: str = "fid", pos: str = "pos") -> DataFrame:
    """Vertices (fid, pos, x, y) with their deltas, the feature's flag and the quantised deltas."""
    along = Window.partitionBy(fid).orderBy(pos)
    whole = Window.partitionBy(fid)
    steps = vertices.withColumn("dx", F.col("x") - F.lag("x").over(along)).withColumn("dy", F.col("y") - F.lag("y").over(along))
    largest = F.max(F.greatest(F.abs("dx"), F.abs("dy"))).over(whole)
    flagged = steps.withColumn("flag", flag_of(F.coalesce(largest, F.lit(0.0))))
    return flagged.withColumn("qx", quantise(F.col("dx"), F.col("flag"))).withColumn("qy", quantise(F.col("dy"), F.col("flag")))


def encode_points(points: np.ndarray, mode: str = "adaptive") -> bytes:
    """points: n x 2 doubles."""
    points = np.ascontiguousarray(points, "<f8").reshape(-1, 2)
    if mode == "raw":
        return np.uint32(len(points)).tobytes() + points.tobytes()
    if len(points) < 2:
        return points.tobytes()
    first, steps = points[0].tobytes(), np.diff(points, axis=0)
    if mode == "plain":
        return first + steps.astype("<f4").tobytes()
    if mode == "truncated":
        steps = steps.astype("<f4")
    largest = float(np.abs(steps).max())
    if mode == "adaptive" and largest < 1.0 or not largest < INT_END:
        flag = FLOAT
    else:
        flag = SHORT if largest < SHORT_END else INT
        steps = np.rint(steps) if mode == "adaptive" else np.trunc(steps)
    return first + bytes([flag]) + steps.astype(_KINDS[flag]).tobytes()


def decode_points(data: bytes, mode: str = "adaptive") -> np.ndarray:
    """The points of an encoded array; deltas are summed one after the other in doubles."""
    if mode == "raw":
        n = int(np.frombuffer(data, "<u4", 1)[0]) if len(data) >= 4 else 0
        return np.frombuffer(data, "<f8", 2 * n, 4).reshape(-1, 2).copy()
    if len(data) < 16:
        return np.zeros((0, 2))
    first = np.frombuffer(data, "<f8", 2).reshape(1, 2)
    if len(data) == 16:
        return first.copy()
    kind, rest = ("<f4", data[16:]) if mode == "plain" else (_KINDS.get(data[16]), data[17:])
    if kind is None:
        return first.copy()
    pair = 2 * np.dtype(kind).itemsize
    steps = np.frombuffer(rest[: len(rest) // pair * pair], kind).reshape(-1, 2).astype("<f8")
    return np.cumsum(np.concatenate([first, steps]), axis=0)


def encode(coords: Column, mode: str = "adaptive") -> Column:
    """The bytes of a coordinate array."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    @F.pandas_udf("binary")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode_points(np.column_stack([np.asarray(x, float), np.asarray(y, float)]), mode) for x, y in zip(xs, ys, strict=True)], dtype=object)

    return run(coords.x, coords.y)


def decode(data: Column, mode: str = "adaptive") -> Column:
    """The coordinate array of bytes."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    @F.pandas_udf("struct<xs:array<double>,ys:array<double>>")
    def run(cells: pd.Series) -> pd.DataFrame:
        points = [decode_points(bytes(c), mode) if c is not None else np.zeros((0, 2)) for c in cells]
        return pd.DataFrame({"xs": [p[:, 0] for p in points], "ys": [p[:, 1] for p in points]})

    both = run(data)
    return F.when(data.isNotNull(), F.zip_with(both.xs, both.ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))


def decode_sql(first: Column, steps: Column) -> Column:
    """The running sum of deltas in column expressions: first point x, y and an array of dx, dy."""
    start = F.struct(first.x.alias("x"), first.y.alias("y"))
    return F.aggregate(
        steps, F.array(start), lambda done, d: F.concat(done, F.array(F.struct((F.element_at(done, -1).x + d.dx).alias("x"), (F.element_at(done, -1).y + d.dy).alias("y"))))
    )


def ratio(features: DataFrame, mode: str = "adaptive") -> DataFrame:
    """Total points, raw and encoded bytes and the saving in per cent."""
    ship(features.sparkSession)
    sizes = features.select((F.size("coords") * 16).cast("long").alias("raw"), F.octet_length(encode(F.col("coords"), mode)).cast("long").alias("packed"))
    sums = sizes.agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("encoded_bytes"))
    return sums.withColumn("ratio", F.when(F.col("raw_bytes") > 0, (1 - F.col("encoded_bytes") / F.col("raw_bytes")) * 100))
