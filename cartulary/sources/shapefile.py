"""Data source "shp": ESRI shapefiles with their dBASE tables, by the published layouts.

    spark.read.format("shp").load(path)

path is a .shp file, a folder or a pattern; a file is one task. Rows are
features: fid (the record's place from 0), geom_type, coords, part_offsets, the
box and a map of attributes as strings, null ones absent. Of every polygon the
exterior rings are kept (clockwise ones); parts follow each other in coords and
part_offsets says where each starts. Null shapes, shapes without points and
unknown shape types are left out.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartulary.schema import GEOM_TYPES
from cartulary.session import ship

# Shape types by kind (plain, with Z, with M).
POINT, LINE, POLYGON, MULTIPOINT = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
SCHEMA = """fid long, geom_type int, coords array<struct<x:double,y:double>>, part_offsets array<int>,
min_x double, min_y double, max_x double, max_y double, properties map<string,string>"""


def _signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def shape(content: bytes) -> tuple[int, list[list[tuple[float, float]]]] | None:
    """Geometry type and parts of a record's content."""
    (kind,) = struct.unpack_from("<i", content)
    if kind in POINT:
        return GEOM_TYPES["POINT"], [[struct.unpack_from("<2d", content, 4)]]
    if kind in MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, 36)
        return GEOM_TYPES["MULTIPOINT"], [[p] for p in struct.iter_unpack("<2d", content[40 : 40 + 16 * n])]
    if kind not in LINE + POLYGON:
        return None
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    at = 44 + 4 * n_parts
    points = list(struct.iter_unpack("<2d", content[at : at + 16 * n_points]))
    parts = [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a]
    if kind in POLYGON:
        outer = [p for p in parts if _signed_area(p) < 0] or parts[:1]
        return GEOM_TYPES["MULTIPOLYGON" if len(outer) > 1 else "POLYGON"], outer
    return GEOM_TYPES["MULTILINE" if len(parts) > 1 else "LINE"], parts


def records(f) -> Iterator[bytes]:
    """The contents of a .shp file's records."""
    head = f.read(100)
    if len(head) < 100 or struct.unpack_from(">i", head)[0] != 9994:
        raise ValueError(f"{f.name} is not a shapefile")
    while head := f.read(8):
        content = f.read(2 * struct.unpack(">2i", head)[1])
        yield content


def table(f, encoding: str) -> Iterator[dict[str, str] | None]:
    """The rows of a .dbf file, None for deleted ones."""
    _, _, _, _, n, head, size = struct.unpack("<4BIHH", f.read(12))
    f.seek(32)
    fields = []
    while (field := f.read(32)) and field[0] != 0x0D:
        fields.append((field[:11].split(b"\0")[0].decode(encoding), chr(field[11]), field[16], field[17]))
    f.seek(head)
    for _ in range(n):
        row = f.read(size)
        at, out = 1, {}
        for name, kind, width, decimals in fields:
            if (text := value(row[at : at + width], kind, decimals, encoding)) is not None:
                out[name] = text
            at += width
        yield None if row[:1] == b"*" else out


def value(raw: bytes, kind: str, decimals: int, encoding: str) -> str | None:
    """A field as a string; blanks are null, but for text."""
    text = raw.decode(encoding, "replace").strip("\0 ")
    if kind in "NF":
        if not text or set(text) == {"*"}:
            return None
        return str(float(text)) if decimals or kind == "F" or "." in text else str(int(text))
    if kind == "D":
        return f"{text[:4]}/{text[4:6]}/{text[6:8]}" if len(text) == 8 and text != "00000000" else None
    if kind == "L":
        return {"T": "1", "Y": "1", "F": "0", "N": "0"}.get(text.upper())
    return text or None


@dataclass
class File(InputPartition):
    path: str


class ShapeReader(DataSourceReader):
    def __init__(self, paths: list[str], encoding: str):
        self.paths, self.encoding = paths, encoding

    def partitions(self):
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        base = partition.path[:-4]
        dbf = next((base + e for e in (".dbf", ".DBF") if os.path.exists(base + e)), None)
        rows = table(open(dbf, "rb"), self.encoding) if dbf else iter(())  # noqa: SIM115  read to its end with the shapes
        with open(partition.path, "rb") as f:
            for fid, content in enumerate(records(f)):
                attributes = next(rows, {})
                found = shape(content)
                if found is None or attributes is None or not any(found[1]):
                    continue
                kind, parts = found
                coords = [p for part in parts for p in part]
                starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
                xs, ys = zip(*coords, strict=True)
                yield fid, kind, coords, starts, min(xs), min(ys), max(xs), max(ys), attributes


class ShapeSource(DataSource):
    @classmethod
    def name(cls):
        return "shp"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        path = self.options["path"].removeprefix("file:")
        found = sorted(glob.glob(f"{path}/*.shp")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return ShapeReader(found, self.options.get("encoding", "utf-8"))


def read(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    ship(spark)
    spark.dataSource.register(ShapeSource)
    return spark.read.format("shp").option("encoding", encoding).load(path)
