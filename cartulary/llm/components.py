"""Connected components of links, by alternating large-star and small-star steps in DataFrame operations.

Each step only needs the least neighbour of a node, a partial aggregate. Where
there are MANY links it is written and read plainly, so that Spark may split the
links of a node with very many of them. Fewer, by their count in every round, are
a few MB: the same steps then run in one task, without shuffles. Every round is
written to the shared folder; rounds end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import cut, forget, settle


#: Links up to which a round runs in one task; beyond, the least neighbours are written before they are joined.
MANY = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another node. No links give no rows."""
    low, high = F.least(a, b), F.greatest(a, b)
    edges = cut(links.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    seen = None
    many = edges.count() > MANY
    while True:
        state = tuple(_few(edges, many).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == seen or not state[0]:
            members = _few(edges, many).groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            named = members.unionAll(_few(edges.select(F.col("v").alias("node"), F.col("v").alias("component")), many).distinct())
            return named if many else cut(_few(named, many), "components")
        before, seen, many = edges, state, state[0] > MANY
        edges = settle(lambda: _round(before, many), "links")
        forget(before)


def _few(df: DataFrame, many: bool) -> DataFrame:
    """df in one partition, unless there are many rows."""
    return df if many else df.coalesce(1)


def _round(edges: DataFrame, many: bool) -> DataFrame:
    """The links (u, v) after a large-star and a small-star step. Steps drop links and turn them round, so few stay few."""
    settled = (lambda df: cut(df, "least")) if many else (lambda df: df)
    both = _few(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), many)
    least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = settled(large.where("u <> v").distinct())
    least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return _few(small.unionAll(least.select("u", F.col("m").alias("v"))), many).distinct()
