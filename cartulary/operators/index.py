"""Spatial indexes as tables.

A cell index is the exploded form (cell, fid), range-partitioned and sorted by
cell when saved, so a probe reads few row groups; a bounds index keeps the boxes
clustered along a Morton curve, so the scan's min/max statistics play the part
of an R-tree. All are built in one pass without gathering anything per cell.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import geohash, hexgrid, s2
from cartulary.functions.geometry import SIDES, intersects
from cartulary.schema import BBox

#: Cells of a query box up to which the index is probed; beyond it a scan of the boxes is cheaper.
MOST_CELLS = 10_000


class SpatialIndex(ABC):
    """build() makes the index table of features, query() gives candidate fids of a box, each once."""

    name: str
    sort_key: str

    def __init__(self, table: DataFrame | None = None):
        self.table = table

    @abstractmethod
    def index(self, features: DataFrame) -> DataFrame: ...

    @abstractmethod
    def candidates(self, box: BBox) -> DataFrame:
        """fids, possibly more than once."""

    @abstractmethod
    def cells(self, box: BBox) -> int:
        """How many cells a probe with the box looks up."""

    def build(self, features: DataFrame) -> SpatialIndex:
        self.table = self.index(features)
        return self

    def query(self, box: BBox) -> DataFrame:
        return self.candidates(box).distinct()

    def loaded(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError(f"the {self.name} index is neither built nor loaded")
        return self.table

    def save(self, path: str) -> None:
        self.loaded().repartitionByRange(self.sort_key).sortWithinPartitions(self.sort_key).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> SpatialIndex:
        self.table = spark.read.parquet(path)
        return self

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        """Whether a finished table lies there."""
        jvm = spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def build_or_load(self, features: DataFrame, path: str, rebuild: bool = False) -> SpatialIndex:
        if rebuild or not self.exists(features.sparkSession, path):
            self.build(features).save(path)
        return self.load(features.sparkSession, path)

    def cell_counts(self) -> DataFrame:
        """Postings per cell."""
        return self.loaded().groupBy("cell").agg(F.count("*").alias("n"))

    def postings(self) -> DataFrame:
        """The list form: cell and its fids in order, for cells that are read one at a time."""
        return self.loaded().groupBy("cell").agg(F.sort_array(F.collect_list("fid")).alias("fids"))


class GeohashIndex(SpatialIndex):
    name, sort_key = "geohash", "cell"

    def __init__(self, precision: int = 6, table: DataFrame | None = None, mode: str = "exact"):
        super().__init__(table)
        self.precision, self.mode = precision, mode

    def index(self, features: DataFrame) -> DataFrame:
        gx, gy = geohash.cover(self.precision, *map(F.col, SIDES))
        rows = features.select("fid", gx.alias("gxs"), F.explode(gy).alias("gy")).select("fid", F.explode("gxs").alias("gx"), "gy")
        return rows.select(geohash.cell_id(F.col("gx"), F.col("gy"), self.precision).alias("cell"), "fid")

    def query_cells(self, box: BBox) -> DataFrame:
        """The query's cells as a table, made by the executors. In sampled mode those under the sample points."""
        spark = self.loaded().sparkSession
        if self.mode == "sampled":
            points = spark.createDataFrame(geohash.sampled_cover(box, self.precision), "lat double, lon double")
            gx, gy = geohash.grid_x(F.col("lon"), self.precision), geohash.grid_y(F.col("lat"), self.precision)
            return points.select(geohash.cell_id(gx, gy, self.precision).alias("cell")).distinct()
        gx, gy = geohash.cover(self.precision, *[F.lit(v) for v in box.astuple()])
        rows = spark.range(1).select(gx.alias("gxs"), F.explode(gy).alias("gy")).select(F.explode("gxs").alias("gx"), "gy")
        return rows.select(geohash.cell_id(F.col("gx"), F.col("gy"), self.precision).alias("cell"))

    def cells(self, box: BBox) -> int:
        return geohash.count_cells(box, self.precision)

    def candidates(self, box: BBox) -> DataFrame:
        cells = self.query_cells(box)
        if self.cells(box) <= MOST_CELLS:
            cells = F.broadcast(cells)
        return self.loaded().join(cells, "cell").select("fid")


class S2Index(SpatialIndex):
    name, sort_key = "s2", "cell"

    def __init__(self, level: int = 15, table: DataFrame | None = None):
        super().__init__(table)
        self.level = level

    def index(self, features: DataFrame) -> DataFrame:
        return s2.cells_of(features, self.level).select("cell", "fid")

    def cells(self, box: BBox) -> int:
        return s2.count_cells(box, self.level)

    def probe_level(self, box: BBox) -> int:
        """The finest level up to the index's at which the box has at most MOST_CELLS cells."""
        level = min(self.level, s2.effective_level(self.level, box))
        while level > 0 and s2.count_cells(box, level) > MOST_CELLS:
            level -= 1
        return level

    def candidates(self, box: BBox) -> DataFrame:
        table, level = self.loaded(), self.probe_level(box)
        ids = s2.cover_box(box, level)
        cells = table.sparkSession.createDataFrame([(int(i),) for i in ids], "probe long")
        own = F.col("cell") if level == self.level else s2.parent_column(F.col("cell"), level)
        span = np.uint64(1 << 2 * (s2.MAX_LEVEL - level)) - np.uint64(1)
        # descendants of a cell are a range of ids, so bounds of all ranges prune the scan
        low, high = ids.view(np.uint64) - span, ids.view(np.uint64) + span
        near = F.col("cell").between(int(low.view(np.int64).min()), int(high.view(np.int64).max())) if len(ids) and (ids >= 0).all() else F.lit(True)
        return table.where(near).withColumn("probe", own).join(F.broadcast(cells), "probe").select("fid")


class HexIndex(SpatialIndex):
    name, sort_key = "hex", "cell"

    def __init__(self, resolution: int = 9, table: DataFrame | None = None, buffer: float | None = None):
        super().__init__(table)
        self.resolution, self.buffer = resolution, hexgrid.buffer_of(resolution) if buffer is None else buffer

    def _cells(self, rows: DataFrame, sides) -> DataFrame:
        x0, y0, x1, y1 = sides
        b = F.lit(self.buffer)
        found = rows.withColumn("r", F.explode(hexgrid.rows_of(y0 - b, y1 + b, self.resolution)))
        found = found.withColumn("q", F.explode(hexgrid.columns_of(x0 - b, x1 + b, F.col("r"), self.resolution)))
        return found.withColumn("cell", hexgrid.cell_id(F.col("q"), F.col("r")))

    def index(self, features: DataFrame) -> DataFrame:
        return self._cells(features.select("fid", *SIDES), map(F.col, SIDES)).select("cell", "fid")

    def cells(self, box: BBox) -> int:
        return hexgrid.count_cells(box.expand(self.buffer), self.resolution)

    def candidates(self, box: BBox) -> DataFrame:
        cells = self._cells(self.loaded().sparkSession.range(1), [F.lit(v) for v in box.astuple()]).select("cell")
        if self.cells(box) <= MOST_CELLS:
            cells = F.broadcast(cells)
        return self.loaded().join(cells, "cell").select("fid")


class BoundsIndex(SpatialIndex):
    """The boxes themselves, in the place of an R-tree."""

    name, sort_key = "bounds", "morton"
    PRECISION = 12

    def index(self, features: DataFrame) -> DataFrame:
        x, y = (F.col("min_x") + F.col("max_x")) / 2.0, (F.col("min_y") + F.col("max_y")) / 2.0
        key = geohash.spread(geohash.grid_x(x, self.PRECISION), geohash.grid_y(y, self.PRECISION), self.PRECISION)
        return features.select("fid", *SIDES, key.alias("morton"))

    def cells(self, box: BBox) -> int:
        return 0

    def candidates(self, box: BBox) -> DataFrame:
        return self.loaded().where(intersects(box)).select("fid")


INDEXES = {c.name: c for c in (GeohashIndex, S2Index, HexIndex, BoundsIndex)}
