"""A feature layer as one Parquet table, clustered by fid, and lookups on it."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.geometry import SIDES
from cartulary.operators.index import SpatialIndex
from cartulary.session import cut


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._cached: DataFrame | None = None

    @classmethod
    def write(cls, features: DataFrame, path: str, mode: str = "overwrite") -> FeatureStore:
        """Range-partitioned and sorted by fid, so that a lookup reads few row groups. Features without coordinates are left out."""
        kept = features.where(F.size("coords") > 0) if "coords" in features.columns else features
        kept.repartitionByRange("fid").sortWithinPartitions("fid").write.mode(mode).parquet(path)
        return cls(features.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FeatureStore:
        if not SpatialIndex.exists(spark, path):
            raise FileNotFoundError(path)
        return cls(spark, path)

    @classmethod
    def ensure(cls, features: DataFrame, path: str) -> FeatureStore:
        """Write only if there is no finished table."""
        return cls(features.sparkSession, path) if SpatialIndex.exists(features.sparkSession, path) else cls.write(features, path)

    @property
    def features(self) -> DataFrame:
        return self._cached if self._cached is not None else self.spark.read.parquet(self.path)

    def cache(self) -> FeatureStore:
        self._cached = self.spark.read.parquet(self.path).cache()
        return self

    def clear_cache(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None
        self.spark.catalog.refreshByPath(self.path)

    def geometries(self) -> DataFrame:
        return self.features.select("fid", "geom_type", "coords", *SIDES)

    def attributes(self) -> DataFrame:
        return self.features.select("fid", "properties")

    def ids(self) -> DataFrame:
        return self.features.select("fid").distinct()

    def has(self, fid: int) -> bool:
        return not self.features.where(F.col("fid") == fid).select("fid").limit(1).isEmpty()

    def get(self, fid: int):
        row = self.features.where(F.col("fid") == fid).head()
        if row is None:
            raise KeyError(fid)
        return row

    def get_attributes(self, fid: int) -> dict[str, str]:
        """An unknown fid has none."""
        row = self.features.where(F.col("fid") == fid).select("properties").head()
        return dict(row.properties or {}) if row else {}

    def get_many(self, fids: DataFrame | list[int]) -> DataFrame:
        return get_many(self.features, fids)

    def sequential(self, n: int) -> DataFrame:
        return sequential(self.features, n)

    def random(self, k: int, seed: int = 42) -> DataFrame:
        return random_features(self.features, k, seed)


def get_many(features: DataFrame, fids: DataFrame | list[int]) -> DataFrame:
    """The features of a list of fids, each once, in the order of fid; unknown fids are skipped. A list is broadcast, a table joined as Spark sees fit."""
    spark = features.sparkSession
    own = F.broadcast(spark.createDataFrame([(int(f),) for f in set(fids)], "fid long")) if isinstance(fids, list) else fids.select("fid").distinct()
    return features.join(own, "fid", "left_semi").orderBy("fid")


def missing(features: DataFrame, fids: DataFrame) -> DataFrame:
    """fids that have no feature."""
    return fids.select("fid").distinct().join(features, "fid", "left_anti")


def sequential(features: DataFrame, n: int) -> DataFrame:
    """The first n features by fid."""
    return features.orderBy("fid").limit(n)


def random_features(features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k features in the order of a seeded hash: the same for the same seed, whatever the partitions."""
    return features.orderBy(F.xxhash64(F.col("fid"), F.lit(seed)), "fid").limit(k)


def random_with_replacement(features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k picks (pick, fid): each the feature whose hash follows a seeded position on the circle of hashes."""
    spark = features.sparkSession
    hashed = cut(features.select(F.xxhash64("fid", F.lit(seed)).alias("h"), "fid"), "hashed")
    picks = spark.range(k).select(F.col("id").alias("pick"), F.xxhash64("id", F.lit(seed + 1)).alias("p"))
    buckets = max(1, min(1 << 16, hashed.count() // 8))
    width = (1 << 64) // buckets + 1

    def bucket(c):
        return F.floor((c.cast("double") + float(1 << 63)) / float(width)).cast("long")

    near = hashed.withColumn("b", bucket(F.col("h"))).join(F.broadcast(picks.withColumn("b", bucket(F.col("p")))), "b").where("h >= p")
    first = near.groupBy("pick").agg(F.min_by("fid", "h").alias("fid"))
    # a pick beyond its bucket's last hash goes on to the next bucket that holds any, and from the end to the first
    least = hashed.groupBy(bucket(F.col("h")).alias("b")).agg(F.min_by("fid", "h").alias("fid")).orderBy("b").collect()  # at most 1 << 16 rows
    held, kept = [r.b for r in least], [r.fid for r in least]
    following = [(b, kept[bisect_right(held, b) % len(kept)] if kept else None) for b in range(buckets + 1)]
    after = spark.createDataFrame(following, "b long, f long")
    rest = picks.withColumn("b", bucket(F.col("p"))).join(first, "pick", "left").join(F.broadcast(after), "b", "left")
    return rest.select("pick", F.coalesce("fid", "f").alias("fid"))
