"""Other ways out and in: GeoJSON lines and cell tables over JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_JSON_TYPES = {0: "Point", 1: "LineString", 2: "Polygon", 3: "MultiPoint", 4: "LineString", 5: "Polygon"}


def geojson(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text. Flattened multi-part lines and polygons are written as one part."""
    pairs = F.transform("coords", lambda p: F.array(p.x, p.y))
    kind = F.lit("Point")
    for code, name in _JSON_TYPES.items():
        kind = F.when(F.col("geom_type") == code, name).otherwise(kind)
    text = F.to_json(pairs)
    body: Column = F.when(kind == "Point", F.to_json(pairs[0])).when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))
    whole = F.concat(F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.to_json("properties"), F.lit("}"))
    return features.where(F.size("coords") > 0).select(whole.alias("value"))


def write_geojson(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    geojson(features).write.mode(mode).text(path)


def read_cells(spark: SparkSession, url: str, table: str = "s2_index", **options: str) -> DataFrame:
    """A cell table (cell_id, fid) of a database, as cell and fid. The database's JDBC driver must be on the class path."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.select(F.col("cell_id").cast("long").alias("cell"), F.col("fid").cast("long").alias("fid"))


def write_cells(index: DataFrame, url: str, table: str = "s2_index", mode: str = "overwrite", **options: str) -> None:
    index.select(F.col("cell").alias("cell_id"), "fid").write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def attributes_json(features: DataFrame) -> DataFrame:
    """fid and its properties as JSON text."""
    return features.select("fid", F.to_json("properties").alias("value"))


def attributes_from_json(rows: DataFrame) -> DataFrame:
    return rows.select("fid", F.from_json("value", "map<string,string>").alias("properties"))
