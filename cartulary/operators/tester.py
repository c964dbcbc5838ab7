"""All indexes of a layer asked for the same boxes: times, candidates and results side by side."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from cartulary.operators.index import SpatialIndex
from cartulary.operators.query import bbox_query
from cartulary.schema import BBox


def compare(features: DataFrame, indexes: list[SpatialIndex], boxes: dict[str, BBox]) -> DataFrame:
    """index_type, box, candidates, results and the milliseconds of the exact query, a row per index and box."""
    rows = []
    for index in indexes:
        for name, box in boxes.items():
            start = time.perf_counter()
            results = bbox_query(features, index, box).count()
            rows.append((index.name, name, index.query(box).count(), results, (time.perf_counter() - start) * 1000))
    return features.sparkSession.createDataFrame(rows, "index_type string, box string, candidates long, results long, time_ms double")
