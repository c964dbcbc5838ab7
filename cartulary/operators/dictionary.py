"""The string pool: attribute keys and values as dense ids in the order in which they are first seen.

Attributes are rows (fid, pos, key, value); a key is seen before its value, rows
in the order of fid and pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import cut

#: Strings of a pool up to which a lookup broadcasts it; larger pools are joined by a shuffle.
BROADCAST_STRINGS = 200_000


def to_rows(features: DataFrame) -> DataFrame:
    """fid, pos, key, value of features with a properties map."""
    return features.select("fid", F.posexplode("properties").alias("pos", "key", "value"))


def build_pool(attributes: DataFrame) -> DataFrame:
    """string_id and value of every distinct string.

    First places come from a partial aggregate. They are then sorted over all
    partitions, and an id is the number of strings in the partitions before plus
    the place in the own one, so no task sees the whole pool.
    """
    both = F.array(F.struct(F.lit(0).alias("kv"), F.col("key").alias("s")), F.struct(F.lit(1).alias("kv"), F.col("value").alias("s")))
    strings = attributes.where("key IS NOT NULL AND value IS NOT NULL").select("fid", "pos", F.explode(both).alias("e")).select("fid", "pos", "e.kv", "e.s")
    first = strings.groupBy("s").agg(F.min(F.struct("fid", "pos", "kv")).alias("first"))
    ordered = first.orderBy("first").select(F.col("s").alias("value"), F.monotonically_increasing_id().alias("place"))
    ordered = cut(ordered, "pool")
    part = F.shiftrightunsigned("place", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + inside).cast("int").alias("string_id"), "value")


def _pool(pool: DataFrame, size: int | None) -> DataFrame:
    n = pool.count() if size is None else size
    return F.broadcast(pool) if n <= BROADCAST_STRINGS else pool


def intern(strings: DataFrame, pool: DataFrame, column: str = "value", size: int | None = None) -> DataFrame:
    """strings with their string_id; null if the pool does not hold them."""
    own = _pool(pool, size).select(F.col("value").alias(column), "string_id")
    return strings.join(own, column, "left")


def lookup(ids: DataFrame, pool: DataFrame, column: str = "string_id", size: int | None = None) -> DataFrame:
    """ids with their string; the empty string if there is none."""
    own = _pool(pool, size).select(F.col("string_id").alias(column), F.col("value"))
    return ids.join(own, column, "left").withColumn("value", F.coalesce("value", F.lit("")))


def encode(attributes: DataFrame, pool: DataFrame) -> DataFrame:
    """fid, pos, key_id, value_id of attribute rows."""
    size = pool.count()
    keys = _pool(pool, size).select(F.col("value").alias("key"), F.col("string_id").alias("key_id"))
    values = _pool(pool, size).select("value", F.col("string_id").alias("value_id"))
    return attributes.join(keys, "key").join(values, "value").select("fid", "pos", "key_id", "value_id")


def encode_pairs(attributes: DataFrame, pool: DataFrame) -> DataFrame:
    """fid and its pairs in order."""
    rows = encode(attributes, pool).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("pos", "key_id", "value_id"))).alias("l"))
    return rows.select("fid", F.transform("l", lambda x: F.struct(x.key_id.alias("key_id"), x.value_id.alias("value_id"))).alias("pairs"))


def decode(encoded: DataFrame, pool: DataFrame, strict: bool = False) -> DataFrame:
    """fid, pos, key, value of encoded rows. strict refuses empty strings, which some readers cannot tell from missing ones."""
    size = pool.count()
    keys = _pool(pool, size).select(F.col("string_id").alias("key_id"), F.col("value").alias("key"))
    values = _pool(pool, size).select(F.col("string_id").alias("value_id"), "value")
    rows = encoded.join(keys, "key_id", "left").join(values, "value_id", "left")
    if strict:
        bad = (F.coalesce("key", F.lit("")) == "") | (F.coalesce("value", F.lit("")) == "")
        rows = rows.withColumn("key", F.when(bad, F.raise_error(F.lit("empty or missing string in the pool"))).otherwise(F.col("key")))
    return rows.select("fid", "pos", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("value", F.lit("")).alias("value"))


def to_maps(rows: DataFrame) -> DataFrame:
    """fid and the properties map of attribute rows; of equal keys the last counts."""
    last = rows.groupBy("fid", "key").agg(F.max(F.struct("pos", "value")).alias("v"))
    grouped = last.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct(F.col("v.pos").alias("pos"), "key", F.col("v.value").alias("value")))).alias("l"))
    return grouped.select("fid", F.map_from_entries(F.transform("l", lambda x: F.struct(x.key, x.value))).alias("properties"))


def pool_stats(pool: DataFrame) -> DataFrame:
    """Strings, bytes, and bytes with a length before each."""
    n = F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long")
    return pool.agg(F.count("*").alias("strings"), n.alias("bytes"), (n + 4 * F.count("*")).alias("stored_bytes"))


def compression_stats(attributes: DataFrame, unit: str = "chars") -> DataFrame:
    """Sizes as text and as id pairs and the saving in per cent; text counted in chars or in bytes."""
    size = F.length if unit == "chars" else F.octet_length
    per = attributes.groupBy("fid").agg(F.sum(size("key") + size("value") + 2).alias("t"), F.count("*").alias("n"))
    sums = per.agg(F.sum(F.lit(12) + F.col("t")).cast("long").alias("original_size"), F.sum(F.lit(12) + 8 * F.col("n")).cast("long").alias("compressed_size"))
    return sums.withColumn("ratio", F.when(F.col("original_size") > 0, (1 - F.col("compressed_size") / F.col("original_size")) * 100))


def sharing(attributes: DataFrame) -> DataFrame:
    """Occurrences, distinct strings and the share of occurrences that the pool saves, in per cent."""
    strings = attributes.select(F.explode(F.array("key", "value")).alias("s"))
    sums = strings.groupBy("s").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("unique"))
    return sums.withColumn("saved", F.when(F.col("total") > 0, (1 - F.col("unique") / F.col("total")) * 100))
