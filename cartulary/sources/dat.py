"""Data source "dat": the record files of a layer.

    spark.read.format("dat").option("kind", K).load(path)

K is geom (fid, geom_type, bbox, coords_bin, offset), attr (fid, pairs, offset),
pool (string_id, value), offsets (fid, geom_offset, attr_offset: the binary form
of an offset index), s2idx (cell, fid) or rtreeidx (fid and the four sides). path
is a file, a folder (files that end in the kind's suffix) or a pattern.

All numbers are little endian. Geometry and attribute files are cut into byte
ranges when an offset index is given (option "splits": offsets, comma-separated);
else a file is one task. Headers are read before coordinates, so filters on fid
and on the box skip the coordinates of records that cannot match.

Writing takes kind geom, attr or pool; each task writes a file, write_layer()
one file of each kind with a JSON offset index beside them, as readers of a
single layer expect.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cartulary.functions import codec
from cartulary.operators import dictionary, offsets
from cartulary.schema import BBOX, PROPERTIES
from cartulary.session import ship

# The layouts of records.
GEOM = struct.Struct("<QB7x4dI")
ATTR = struct.Struct("<QI")
PAIR = struct.Struct("<II")
OFFSET = struct.Struct("<Qqq")
RTREE = struct.Struct("<4di")
SUFFIX = {"geom": "_geom.dat", "attr": "_attr.dat", "pool": "_pool.dat", "offsets": "_index.bin", "s2idx": "_s2.idx", "rtreeidx": "_rtree.idx"}
SCHEMAS = {
    "geom": "fid long, geom_type int, bbox struct<min_x:double,min_y:double,max_x:double,max_y:double>, coords_bin binary, offset long",
    "attr": "fid long, pairs array<struct<key_id:int,value_id:int>>, offset long",
    "pool": "string_id int, value string",
    "offsets": "fid long, geom_offset long, attr_offset long",
    "s2idx": "cell long, fid long",
    "rtreeidx": "min_x double, min_y double, max_x double, max_y double, fid long",
}


class Truncated(ValueError):
    """A file ends inside a record."""


def _take(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise Truncated(f"{getattr(f, 'name', 'file')}: {n} bytes expected, {len(data)} left")
    return data


def pack_geometry(fid: int, kind: int, box: tuple[float, float, float, float], coords: bytes) -> bytes:
    return GEOM.pack(fid, kind, *box, len(coords)) + coords


def pack_attributes(fid: int, pairs: list[tuple[int, int]]) -> bytes:
    return ATTR.pack(fid, len(pairs)) + b"".join(PAIR.pack(*p) for p in pairs)


def pack_pool(values: list[str]) -> bytes:
    raw = [v.encode() for v in values]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(r)) + r for r in raw)


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


class DatReader(DataSourceReader):
    def __init__(self, kind: str, paths: list[str], splits: list[int]):
        self.kind, self.paths, self.splits = kind, paths, splits
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Comparisons of fid, geom_type and the box's sides are tested on headers; all filters run again in Spark."""
        for f in filters:
            name = "/".join(f.attribute) if hasattr(f, "attribute") else ""
            if self.kind == "geom" and type(f) in _TESTS and name in ("fid", "geom_type", "bbox/min_x", "bbox/min_y", "bbox/max_x", "bbox/max_y"):
                self.tests.append((name.removeprefix("bbox/"), type(f).__name__, f.value))
            yield f

    def partitions(self):
        if not self.splits or self.kind not in ("geom", "attr"):
            return [Range(p, 0, None) for p in self.paths]
        cuts = [0, *self.splits, None]
        return [Range(p, a, b) for p in self.paths for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(0, os.SEEK_END)
            size = f.tell()
            f.seek(partition.start)
            yield from getattr(self, f"_{self.kind}")(f, size if partition.end is None else min(partition.end, size))

    def _geom(self, f, end):
        tests = [(n, _TESTS[{t.__name__: t for t in _TESTS}[k]], v) for n, k, v in self.tests]
        while (at := f.tell()) < end:
            fid, kind, *box, n = GEOM.unpack(_take(f, GEOM.size))
            head = {"fid": fid, "geom_type": kind, "min_x": box[0], "min_y": box[1], "max_x": box[2], "max_y": box[3]}
            if all(t(head[name], v) for name, t, v in tests):
                yield fid, kind, tuple(box), _take(f, n), at
            else:
                f.seek(n, os.SEEK_CUR)

    def _attr(self, f, end):
        while (at := f.tell()) < end:
            fid, n = ATTR.unpack(_take(f, ATTR.size))
            yield fid, list(PAIR.iter_unpack(_take(f, n * PAIR.size))), at

    def _pool(self, f, end):
        (n,) = struct.unpack("<I", _take(f, 4))
        for i in range(n):
            (size,) = struct.unpack("<I", _take(f, 4))
            yield i, _take(f, size).decode()

    def _offsets(self, f, end):
        (n,) = struct.unpack("<I", _take(f, 4))
        for _ in range(n):
            yield OFFSET.unpack(_take(f, OFFSET.size))

    def _s2idx(self, f, end):
        (n,) = struct.unpack("<Q", _take(f, 8))
        for _ in range(n):
            cell, m = struct.unpack("<qQ", _take(f, 16))
            for fid in struct.unpack(f"<{m}i", _take(f, 4 * m)):
                yield cell, fid

    def _rtreeidx(self, f, end):
        (n,) = struct.unpack("<Q", _take(f, 8))
        for _ in range(n):
            yield RTREE.unpack(_take(f, RTREE.size))


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


class DatWriter(DataSourceWriter):
    """A file per task, under its final name only once all tasks are done."""

    def __init__(self, kind: str, path: str, overwrite: bool):
        if kind not in ("geom", "attr", "pool"):
            raise ValueError(f"kind {kind} cannot be written")
        self.kind, self.path, self.overwrite, self.run = kind, path, overwrite, uuid.uuid4().hex[:8]

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        final = f"{self.path}/part-{part:05d}-{self.run}{SUFFIX[self.kind]}"
        part_path = f"{final}.{uuid.uuid4().hex[:8]}.tmp"
        with open(part_path, "wb") as f:
            if self.kind == "pool":
                f.write(pack_pool([r.value for r in sorted(rows, key=lambda r: r.string_id)]))
            elif self.kind == "geom":
                for r in rows:
                    f.write(pack_geometry(r.fid, r.geom_type, tuple(r.bbox), bytes(r.coords_bin)))
            else:
                for r in rows:
                    f.write(pack_attributes(r.fid, [tuple(p) for p in r.pairs]))
        return Written(part_path, final)

    def commit(self, messages):
        done = {m.final for m in messages if m}
        for m in messages:
            if m:
                os.replace(m.path, m.final)
        if self.overwrite:
            for p in glob.glob(f"{self.path}/*{SUFFIX[self.kind]}"):
                if p not in done:
                    os.remove(p)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class DatSource(DataSource):
    @classmethod
    def name(cls):
        return "dat"

    def _kind(self) -> str:
        kind = self.options.get("kind", "geom")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {sorted(SCHEMAS)}")
        return kind

    def schema(self):
        return SCHEMAS[self._kind()]

    def reader(self, schema):
        path = self.options["path"].removeprefix("file:")
        found = sorted(glob.glob(f"{path}/*{SUFFIX[self._kind()]}")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        splits = [int(x) for x in self.options.get("splits", "").split(",") if x]
        return DatReader(self._kind(), found, splits)

    def writer(self, schema, overwrite):
        return DatWriter(self._kind(), self.options["path"].removeprefix("file:"), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters
    spark.dataSource.register(DatSource)


def read(spark: SparkSession, kind: str, path: str, splits: list[int] | None = None) -> DataFrame:
    register(spark)
    return spark.read.format("dat").option("kind", kind).option("splits", ",".join(map(str, splits or []))).load(path)


def encoded_layer(features: DataFrame, mode: str = "adaptive") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Geometry records, attribute records and the pool of features, each record with its offset in the order of fid."""
    spark = features.sparkSession
    ship(spark)
    box = F.struct(*[F.col(c) for c in BBOX.names])
    geom = features.where(F.size("coords") > 0).select("fid", "geom_type", box.alias("bbox"), codec.encode(F.col("coords"), mode).alias("coords_bin"))
    geom = offsets.running_offsets(geom.withColumn("n_bytes", offsets.geometry_size(F.col("coords_bin")).cast("long")), "n_bytes")
    rows = dictionary.to_rows(features.where(F.size("coords") > 0))
    pool = dictionary.build_pool(rows)
    empty = F.array().cast("array<struct<key_id:int,value_id:int>>")
    attr = features.where(F.size("coords") > 0).select("fid").join(dictionary.encode_pairs(rows, pool), "fid", "left").withColumn("pairs", F.coalesce("pairs", empty))
    attr = offsets.running_offsets(attr.withColumn("n_bytes", (offsets.ATTR_HEADER + offsets.PAIR * F.size("pairs")).cast("long")), "n_bytes")
    return geom, attr, pool


def write_layer(features: DataFrame, folder: str, name: str, mode: str = "adaptive") -> dict[str, str]:
    """Write <name>_geom.dat, _attr.dat, _pool.dat and _index.dat for readers that expect one file of each.

    A single file has a single writer: records are streamed to the driver in the
    order of fid, a partition at a time. Layers for Spark belong in Parquet.
    """
    geom, attr, pool = encoded_layer(features, mode)
    os.makedirs(folder, exist_ok=True)
    paths = {k: f"{folder}/{name}{s}" for k, s in (("geom", "_geom.dat"), ("attr", "_attr.dat"), ("pool", "_pool.dat"), ("index", "_index.dat"))}
    with open(paths["geom"], "wb") as f:
        for r in geom.orderBy("fid").toLocalIterator():
            f.write(pack_geometry(r.fid, r.geom_type, tuple(r.bbox), bytes(r.coords_bin)))
    with open(paths["attr"], "wb") as f:
        for r in attr.orderBy("fid").toLocalIterator():
            f.write(pack_attributes(r.fid, [tuple(p) for p in r.pairs]))
    with open(paths["pool"], "wb") as f:
        f.write(pack_pool([r.value for r in pool.orderBy("string_id").toLocalIterator()]))
    index = geom.select("fid", F.col("offset").alias("geom_offset")).join(attr.select("fid", F.col("offset").alias("attr_offset")), "fid").orderBy("fid")
    with open(paths["index"], "w") as f:
        f.write('{"version": 1, "data": {"features": {')
        for i, r in enumerate(index.toLocalIterator()):
            f.write(("" if i == 0 else ", ") + json.dumps(str(r.fid)) + ": " + json.dumps({"geom_offset": r.geom_offset, "attr_offset": r.attr_offset}))
        f.write("}}}")
    return paths


def read_layer(spark: SparkSession, folder: str, name: str, mode: str = "adaptive") -> DataFrame:
    """The features of a layer's files; of records of one fid the last."""
    geom = offsets.last_wins(read(spark, "geom", f"{folder}/{name}_geom.dat"))
    attr = offsets.last_wins(read(spark, "attr", f"{folder}/{name}_attr.dat"))
    pool = read(spark, "pool", f"{folder}/{name}_pool.dat")
    rows = attr.select("fid", F.posexplode("pairs").alias("pos", "p")).select("fid", "pos", "p.key_id", "p.value_id")
    maps = dictionary.to_maps(dictionary.decode(rows, pool))
    sides = [F.col(f"bbox.{c}").alias(c) for c in BBOX.names]
    shapes = geom.select("fid", "geom_type", codec.decode(F.col("coords_bin"), mode).alias("coords"), *sides)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return shapes.join(maps, "fid", "left").withColumn("properties", F.coalesce("properties", none.cast(PROPERTIES)))


def index_table(features: DataFrame, path: str, kind: str) -> None:
    """Write an index (cell, fid or the bounds) in its binary file form, streamed in order by one writer."""
    n = features.count() if kind == "rtreeidx" else features.select("cell").distinct().count()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", n))
        if kind == "rtreeidx":
            for r in features.orderBy("fid").toLocalIterator():
                f.write(RTREE.pack(r.min_x, r.min_y, r.max_x, r.max_y, r.fid))
        else:
            lists = features.groupBy("cell").agg(F.sort_array(F.collect_list("fid")).alias("fids")).orderBy("cell")
            for r in lists.toLocalIterator():
                f.write(struct.pack("<qQ", r.cell, len(r.fids)) + struct.pack(f"<{len(r.fids)}i", *r.fids))


