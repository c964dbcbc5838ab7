"""Layer profiles: distributions, totals, integrity, consistency and size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.geometry import geometry_name

# Bytes of an id and an offset in an offset index, the overhead of keeping it, the target size, the limits of memory classes in GB.
OFFSET_BYTES, OVERHEAD, TARGET = 16, 2, 10_000_000
PRESSURE = ((1, "low"), (4, "medium"), (8, "high"))
MIB, GIB = 1024.0**2, 1024.0**3


def _share(part, whole):
    return F.when(whole > 0, part * 100.0 / whole)


def geom_type_distribution(features: DataFrame, size: str | None = None) -> DataFrame:
    """Features, share in per cent and, with a size column, bytes per geometry type."""
    aggs = [F.count("*").alias("n")] + ([F.sum(size).cast("long").alias("bytes")] if size else [])
    counts = features.groupBy("geom_type").agg(*aggs)
    total = counts.agg(F.sum("n").alias("total"))  # six types at most
    whole = counts.crossJoin(F.broadcast(total)).withColumn("percent", _share(F.col("n"), F.col("total"))).drop("total")
    return whole.withColumn("name", geometry_name(F.col("geom_type")))


def field_distribution(attributes: DataFrame, features: DataFrame) -> DataFrame:
    """Features that have a field, their share of all features in per cent, and bytes of its values. attributes: fid, key, value."""
    counts = attributes.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).cast("long").alias("bytes"))
    total = features.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", _share(F.col("n"), F.col("total"))).drop("total")


def layer_totals(geometry: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row of sums and means. geometry: fid, coords_n, geom_bytes; attributes: fid, key, value."""
    g = geometry.agg(F.count("*").alias("features"), F.sum("coords_n").cast("long").alias("coords"), F.sum("geom_bytes").cast("long").alias("geom_bytes"))
    a = attributes.agg(F.count("*").alias("fields"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("value")), F.lit(0)).cast("long").alias("attr_bytes"))
    both = g.crossJoin(F.broadcast(a))  # one row each
    means = {f"{c}_per_feature": F.when(F.col("features") > 0, F.col(c) / F.col("features")) for c in ("coords", "geom_bytes", "fields", "attr_bytes")}
    return both.withColumns(means)


def integrity(geometry: DataFrame, attributes: DataFrame) -> DataFrame:
    """Share of geometries with coordinates and of attribute records with properties, in per cent. geometry: coords_n; attributes: n_properties."""
    g = geometry.agg(F.count("*").alias("geometries"), F.count_if(F.col("coords_n") > 0).alias("valid_geometries"))
    a = attributes.agg(F.count("*").alias("records"), F.count_if(F.col("n_properties") > 0).alias("valid_records"))
    both = g.crossJoin(F.broadcast(a))
    return both.withColumn("geometry_percent", _share(F.col("valid_geometries"), F.col("geometries"))).withColumn("attribute_percent", _share(F.col("valid_records"), F.col("records")))


def consistency(ids: DataFrame, geometry: DataFrame, attributes: DataFrame, limit: float = 0.05) -> DataFrame:
    """Of all known fids how many lack geometry, attributes or both, and whether each share is within the limit."""
    g = geometry.select("fid").distinct().withColumn("g", F.lit(True))
    a = attributes.select("fid").distinct().withColumn("a", F.lit(True))
    whole = ids.select("fid").distinct().join(g, "fid", "full_outer").join(a, "fid", "full_outer")
    no_g, no_a = F.col("g").isNull(), F.col("a").isNull()
    sums = whole.agg(F.count("*").alias("fids"), F.count_if(no_g & no_a).alias("missing_both"), F.count_if(no_g & ~no_a).alias("missing_geometry"), F.count_if(~no_g & no_a).alias("missing_attributes"))
    worst = F.greatest("missing_both", "missing_geometry", "missing_attributes")
    return sums.withColumn("consistent", worst <= F.col("fids") * limit)


def memory_estimate(geometry_bytes: DataFrame, attribute_bytes: DataFrame, target: int = TARGET) -> DataFrame:
    """Current and projected sizes. Each input: a row per record with n_bytes."""
    g = geometry_bytes.agg(F.count("*").alias("elements"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("geometry_bytes"))
    a = attribute_bytes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("attribute_bytes"))
    one = g.crossJoin(F.broadcast(a)).withColumn("offset_index_bytes", F.col("elements") * OFFSET_BYTES).withColumn("estimated_bytes", F.col("elements") * OFFSET_BYTES * OVERHEAD)
    scale = F.when(F.col("elements") > 0, F.lit(float(target)) / F.col("elements"))
    one = one.withColumn("target_geometry_mb", F.col("geometry_bytes") * scale / MIB).withColumn("target_attribute_mb", F.col("attribute_bytes") * scale / MIB)
    one = one.withColumn("target_index_mb", F.lit(float(target * OFFSET_BYTES * OVERHEAD)) / MIB)
    one = one.withColumn("target_total_gb", (F.col("target_geometry_mb") + F.col("target_attribute_mb") + F.col("target_index_mb")) / 1024.0)
    level = F.lit("very high")
    for limit, name in reversed(PRESSURE):
        level = F.when(F.col("target_total_gb") < limit, name).otherwise(level)
    return one.withColumn("pressure", level)


def index_memory(cells: DataFrame) -> DataFrame:
    """Cells and postings of a cell index (cell, fid) and the bytes of its list form: a key and a count per cell, an id per posting."""
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))
    sums = counts.agg(F.count("*").alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("postings"))
    return sums.withColumn("bytes", F.col("cells") * 16 + F.col("postings") * 8)


def conversion_stats(features: DataFrame, pool: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row on a conversion: total and valid features, sizes, pool strings and the bytes the pool saves. features: coords_n, geom_bytes."""
    from cartulary.operators.dictionary import compression_stats

    f = features.agg(F.count("*").alias("total"), F.count_if(F.col("coords_n") > 0).alias("valid"), F.sum("geom_bytes").cast("long").alias("geometry_size"))
    p = pool.agg(F.count("*").alias("pool_size"))
    c = compression_stats(attributes, "bytes").select("original_size", F.col("compressed_size").alias("attribute_size"), (F.col("original_size") - F.col("compressed_size")).alias("saved_bytes"), "ratio")
    return f.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(c))
