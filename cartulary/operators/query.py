"""Box queries: candidates of an index, bounds, and the exact rectangle or geometry check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import geohash
from cartulary.functions.geometry import SIDES, intersects, rect_intersects
from cartulary.operators.index import MOST_CELLS, BoundsIndex, SpatialIndex
from cartulary.schema import BBox


def scan_query(features: DataFrame, box: BBox) -> DataFrame:
    """All features whose box meets the query's: one pass with pushed-down comparisons."""
    return features.where(intersects(box))


def bbox_query(features: DataFrame, index: SpatialIndex, box: BBox, bounds: BoundsIndex | None = None, use_bounds: bool = True, exact: bool = True) -> DataFrame:
    """fids of a box, each once: cells, then bounds, then the exact check, as the flags say.

    With the exact check the answer is that of the scan. So a box with too many
    cells to probe skips the cells, and the exact check and the bounds are one filter.
    """
    if exact and index.cells(box) > MOST_CELLS:
        return scan_query(features, box).select("fid").distinct()
    found = index.query(box)
    if use_bounds and bounds is not None:
        found = found.join(bounds.query(box), "fid", "left_semi")
    if exact:
        found = found.join(scan_query(features.select("fid", *SIDES), box).select("fid"), "fid", "left_semi")
    return found


def region_query(features: DataFrame, index: SpatialIndex, box: BBox) -> DataFrame:
    """Feature records of a box."""
    return scan_query(features, box).join(index.query(box), "fid", "left_semi")


def geometry_query(features: DataFrame, index: SpatialIndex, box: BBox) -> DataFrame:
    """Feature records whose true geometry meets the box: candidates of the index first."""
    return rect_intersects(features.join(index.query(box), "fid", "left_semi"), box)


def display_flags(features: DataFrame, hits: DataFrame) -> DataFrame:
    """All features with is_hit."""
    marked = hits.select("fid").distinct().withColumn("hit", F.lit(True))
    return features.join(marked, "fid", "left").withColumn("is_hit", F.coalesce("hit", F.lit(False))).drop("hit")


def precision_of(features: DataFrame, index: SpatialIndex, box: BBox) -> DataFrame:
    """Candidates, results and their ratio."""
    own = features.select("fid", *SIDES).withColumn("exact", intersects(box))
    found = index.query(box).join(own, "fid")
    sums = found.agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).cast("long").alias("results"))
    return sums.withColumn("ratio", F.when(F.col("candidates") > 0, F.col("results") / F.col("candidates")))


def boxes_query(features: DataFrame, boxes: DataFrame, precision: int = 5) -> DataFrame:
    """Pairs (box_id, fid) of many boxes at once: an equi-join on shared cells, then the rectangle check.

    Of the cells that a pair shares only the one of the upper of both lower
    corners counts, so a pair comes once without a distinct.
    """
    sides = dict(zip(SIDES, ("b0", "b1", "b2", "b3"), strict=True))

    def celled(rows: DataFrame) -> DataFrame:
        gx, gy = geohash.cover(precision, *map(F.col, SIDES))
        return rows.withColumn("gxs", gx).withColumn("gy", F.explode(gy)).withColumn("gx", F.explode("gxs")).drop("gxs")

    left = celled(features.select("fid", *SIDES))
    right = celled(boxes.select("box_id", *SIDES))
    for a, b in sides.items():
        right = right.withColumnRenamed(a, b)
    met = left.join(right, ["gx", "gy"])
    near = reduce(lambda a, b: a & b, [F.col("min_x") <= F.col("b2"), F.col("max_x") >= F.col("b0"), F.col("min_y") <= F.col("b3"), F.col("max_y") >= F.col("b1")])
    own_x, own_y = geohash.grid_x(F.greatest("min_x", "b0"), precision), geohash.grid_y(F.greatest("min_y", "b1"), precision)
    return met.where(near & (F.col("gx") == own_x) & (F.col("gy") == own_y)).select("box_id", "fid")
