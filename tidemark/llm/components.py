"""Connected components of a table of links, by alternating star contractions.

Each step groups a node's neighbours only to their smallest one, so no neighbourhood is ever collected; a
star's centre meets its neighbours in a join of written tables, which Spark can split where one is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every larger neighbour of a node (large), or every smaller one and itself, with the smallest."""
    both = links.union(links.select("v", "u")) if large else links
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long) that has another; component is its smallest node."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    seen = None
    while True:
        links = materialize(_star(links, True).filter("u <> v").distinct(), "links")
        links = materialize(_star(links, False).filter("u <> v").distinct(), "links")
        # The same links again: each node is linked with its component's smallest node alone.
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        seen = now
