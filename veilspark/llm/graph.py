"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import stored


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    nodes = edges.select("u").union(edges.select("v").distinct())
    return nodes.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= 1


def _to_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node reaches. links: two columns of longs.

    Every round is a few joins and partial aggregations over the edges, written to the shared
    folder; the number of rounds grows with the logarithm of the largest component. They end when each edge
    leads to the least node of its component, so links that are stars need none.
    """
    a, b = links.columns
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges", narrow=True)
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large-star", narrow=True)
        down = _to_least(large)
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u <> v").distinct(), "small-star", narrow=True)
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
