"""Record sizes and offset indexes of the file formats, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.session import cut

# Bytes of a geometry record before its coordinates with and without padding, of an attribute record before its pairs, of a pair.
GEOM_HEADER, GEOM_HEADER_TIGHT, ATTR_HEADER, PAIR = 52, 45, 12, 8
JSON_SCHEMA = "version INT, data STRUCT<features: MAP<STRING, STRUCT<geom_offset: LONG, attr_offset: LONG>>>"


def geometry_size(coords_bin: Column) -> Column:
    """A stored geometry record: id, type, padding, box, length, coordinates."""
    return F.lit(GEOM_HEADER) + F.octet_length(coords_bin)


def attribute_text_size(properties: Column) -> Column:
    """An attribute record as JSON-like text: 12 bytes, braces, and per entry both strings, four quotes and a colon, with commas between."""
    entries = F.map_entries(properties)
    inner = F.aggregate(entries, F.lit(0), lambda n, e: n + F.octet_length(e.key) + F.octet_length(e.value) + 5)
    return F.lit(14) + inner + F.greatest(F.size(entries) - 1, F.lit(0))


def running_offsets(records: DataFrame, size: str, key: str = "fid") -> DataFrame:
    """records with the offset of each when written one after the other in the order of key."""
    return running_sums(records, {"offset": size}, key)


def running_sums(records: DataFrame, sizes: dict[str, str], key: str = "fid") -> DataFrame:
    """records with the sum of each size column over all records before, under the names given.

    Sizes are summed per range of one sort and ranges are added up in a table of
    a row each, so no task passes over all records.
    """
    ordered = cut(records.orderBy(key).withColumn("place__", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("place__", 33)
    sums = ordered.groupBy(part.alias("part__")).agg(*[F.sum(c).alias(f"{n}__") for n, c in sizes.items()])
    ranges = Window.orderBy("part__")
    before = sums.select("part__", *[(F.sum(f"{n}__").over(ranges) - F.col(f"{n}__")).alias(f"{n}__") for n in sizes])
    along = Window.partitionBy("part__").orderBy("place__").rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumn("part__", part).join(F.broadcast(before), "part__")
    out = rows.withColumns({n: (F.col(f"{n}__") + F.sum(c).over(along) - F.col(c)).cast("long") for n, c in sizes.items()})
    return out.drop("part__", "place__", *[f"{n}__" for n in sizes])


def last_wins(records: DataFrame, key: str = "fid", order: str = "offset") -> DataFrame:
    """Of records of one key the one appended last."""
    rest = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def to_json(offsets: DataFrame, group: str | None = None) -> DataFrame:
    """The JSON text of an offset index (fid, geom_offset, attr_offset). The format is one document, so one row holds it."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("fid").cast("string").alias("k"), F.struct("geom_offset", "attr_offset").alias("v"))))
    text = F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.map_from_entries(entries).alias("features")).alias("data")))
    return offsets.groupBy(*([group] if group else [])).agg(text.alias("value"))


def from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """fid, geom_offset, attr_offset of JSON index documents. A document without a version or without features fails."""
    parsed = documents.select(F.from_json(column, JSON_SCHEMA).alias("j"))
    whole = F.col("j.version").isNotNull() & F.col("j.data.features").isNotNull()
    checked = parsed.select(F.when(whole, F.col("j.data.features")).otherwise(F.raise_error(F.lit("not an offset index: version or data.features is missing"))).alias("f"))
    return checked.select(F.explode("f").alias("fid", "o")).select(F.col("fid").cast("long").alias("fid"), "o.geom_offset", "o.attr_offset")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path, wholetext=True))
