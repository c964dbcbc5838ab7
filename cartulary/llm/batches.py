"""Helpers for columns and Arrow batches: ids, free names, slices of bounded size, flat views of list and string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 2 << 20


def numbered(df: DataFrame, name: str) -> Column:
    """An id column as long; ids that are no integers are refused before anything runs."""
    kind = df.select(f"`{name}`").schema[0].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{name} must hold integers, not {kind}")
    return F.col(f"`{name}`").cast("long")


def free(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Let Spark hand Arrow batches to Python that are bounded in bytes and not only in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def pieces(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of one row or of at most size bytes in column."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(lens):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lens):
        yield batch.slice(start, len(lens) - start)


def as_lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values in a row and each list's length."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null is empty."""
    return [x if x is not None else "" for x in batch.column(column).to_pylist()]
