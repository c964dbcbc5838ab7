"""A feature layer derived from the order tables, for tables that hold no coordinates.

The same SQL, but for the names of its functions, runs in other engines; see
plans.registry for the counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = """
SELECT o_orderkey AS fid, CAST(o_orderkey % 6 AS INT) AS geom_type,
  CAST(102 AS DOUBLE) + CAST((o_orderkey*7919) % 300000 AS DOUBLE)/CAST(100000 AS DOUBLE) AS min_x,
  CAST(25 AS DOUBLE) + CAST((o_orderkey*104729) % 300000 AS DOUBLE)/CAST(100000 AS DOUBLE) AS min_y,
  CAST(102 AS DOUBLE) + CAST((o_orderkey*7919) % 300000 + 10 + o_orderkey % 400 AS DOUBLE)/CAST(100000 AS DOUBLE) AS max_x,
  CAST(25 AS DOUBLE) + CAST((o_orderkey*104729) % 300000 + 10 + o_orderkey % 300 AS DOUBLE)/CAST(100000 AS DOUBLE) AS max_y
FROM {orders}
"""

POINTS = "CASE WHEN geom_type IN (0,3) THEN 1 WHEN geom_type IN (1,4) THEN CAST(2 + fid % 5 AS INT) ELSE 5 END"

VERTICES = """
SELECT fid, geom_type, CAST(pos AS INT) AS pos,
  CASE WHEN geom_type IN (2,5) THEN CASE WHEN pos IN (1,2) THEN max_x ELSE min_x END
       WHEN n = 1 THEN min_x ELSE min_x + (max_x-min_x)*CAST(pos AS DOUBLE)/CAST(n-1 AS DOUBLE) END AS x,
  CASE WHEN geom_type IN (2,5) THEN CASE WHEN pos IN (2,3) THEN max_y ELSE min_y END
       WHEN n = 1 THEN min_y ELSE min_y + (max_y-min_y)*CAST(pos AS DOUBLE)/CAST(n-1 AS DOUBLE) END AS y
FROM ({numbered})
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, geom_type and the four sides of the box."""
    return spark.sql(FEATURES.replace("{orders}", "{orders}"), orders=_table(spark, sf_dir, "orders"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, geom_type, pos, x, y: points are the box's corner, lines its diagonal, polygons its closed ring."""
    numbered = features(spark, sf_dir).withColumn("n", F.expr(POINTS)).withColumn("pos", F.explode(F.expr("sequence(0, n - 1)")))
    return spark.sql(VERTICES.replace("({numbered})", "{numbered}"), numbered=numbered)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, pos, key, value: a row per attribute that is not null."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    fields = F.array(
        _field("status", 0, F.col("o_orderstatus")),
        _field("priority", 1, F.col("o_orderpriority")),
        _field("cents", 2, F.when(F.col("fid") % 7 != 0, cents)),
        _field("note", 3, F.when(F.col("fid") % 50 == 0, "").otherwise("n")),
    )
    return o.select("fid", F.explode(fields).alias("f")).where("f.value IS NOT NULL").select("fid", "f.pos", "f.key", "f.value")


def _field(key: str, pos: int, value):
    return F.struct(F.lit(key).alias("key"), F.lit(pos).alias("pos"), value.alias("value"))


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with coordinates and properties, built in one pass over the orders."""
    f = features(spark, sf_dir).withColumn("n", F.expr(POINTS))
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y"))])

    def along(low: str, high: str, pos):
        return F.when(F.col("n") == 1, F.col(low)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * pos.cast("double") / (F.col("n") - 1).cast("double"))

    line = F.transform(F.expr("sequence(0, n - 1)"), lambda p: F.struct(along("min_x", "max_x", p).alias("x"), along("min_y", "max_y", p).alias("y")))
    coords = F.when(F.col("geom_type").isin(2, 5), ring).otherwise(line)
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    cents = F.when(F.col("fid") % 7 != 0, F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    values = F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), cents, F.when(F.col("fid") % 50 == 0, "").otherwise("n"))
    whole = F.map_from_arrays(F.array(*map(F.lit, ("status", "priority", "cents", "note"))), values)
    properties = F.map_filter(whole, lambda k, v: v.isNotNull())
    joined = f.join(o, "fid")
    return joined.select("fid", "geom_type", coords.alias("coords"), "min_x", "min_y", "max_x", "max_y", properties.alias("properties"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark timings: index_type, data_size, time_ms, from the events table."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "s2").otherwise("ogr")
    sizes = F.element_at(F.array(*[F.lit(n).cast("long") for n in (100, 500, 1000, 5000, 10000)]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", kind.alias("index_type"), sizes.alias("data_size"), F.col("value").alias("time_ms"))
