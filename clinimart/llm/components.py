"""Connected components of a table of links, in rounds over the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written_once


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u, v``); the root is the smallest
    node of its component. Null links and loops are left out.

    Each round first ties every larger neighbour of a node to the node's smallest
    neighbour, then every smaller one. Both keep the components, and a number of
    rounds in the order of the logarithm of the component's size leaves each node
    tied to its root alone. Minima are taken before the shuffle, neighbours are never
    gathered, and every round is written, so a lost executor loses one round."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written_once(edges, "links")
    before = None
    while True:
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = edges.select(F.col("u").alias("n"), F.col("v").alias("u")).join(least, "u")
        tied = larger.select(F.col("n").alias("u"), F.col("m").alias("v")).filter("u <> v")
        own = least.filter("m < u").select("u", F.col("m").alias("v"))
        wide = tied.unionByName(own).distinct()
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        smaller = wide.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        own = least.select("u", F.col("m").alias("v"))
        edges = written_once(smaller.unionByName(own).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        if now == before or now[0] == now[2] and not _chained(edges):
            return _rooted(edges)
        before = now


def _chained(edges: DataFrame) -> bool:
    """Whether some root is itself tied to another node."""
    return bool(edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").limit(1).count())


def _rooted(edges: DataFrame) -> DataFrame:
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
