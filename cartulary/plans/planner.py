"""Which way a box query takes, and the cost figures behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cartulary.operators.index import MOST_CELLS, BoundsIndex, SpatialIndex
from cartulary.operators.query import bbox_query, scan_query
from cartulary.schema import BBox


@dataclass(frozen=True)
class Choice:
    """way: probe or scan; cells: how many a probe looks up."""

    way: str
    cells: int
    reason: str


def choose(index: SpatialIndex | None, box: BBox) -> Choice:
    """Probe while the cells of the box fit a small broadcast; otherwise the scan's pushed-down comparisons do better."""
    if index is None or index.table is None:
        return Choice("scan", 0, "no index")
    cells = index.cells(box)
    if cells > MOST_CELLS:
        return Choice("scan", cells, f"more than {MOST_CELLS} cells")
    return Choice("probe", cells, "few cells")


def run(features: DataFrame, index: SpatialIndex | None, box: BBox, bounds: BoundsIndex | None = None) -> tuple[DataFrame, Choice]:
    """The exact answer (fids) by the chosen way, and the choice."""
    choice = choose(index, box)
    if choice.way == "scan":
        return scan_query(features, box).select("fid").distinct(), choice
    return bbox_query(features, index, box, bounds), choice
