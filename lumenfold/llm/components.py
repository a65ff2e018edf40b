"""Connected components of a table of links, by alternating stars over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the least of the node and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the least of these. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) links of long nodes, any order, repeats and loops allowed -> (node, root), root the least of its component.

    Only nodes that have a link with another node are returned, roots among them. Nulls are ignored.
    Each round is a written table, so an executor lost later costs that round only. A node with very
    many links is a skewed join key, which adaptive execution splits; its minimum is taken in parts.
    """
    links = links.filter("u is not null and v is not null and u <> v")
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        after = stored(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
