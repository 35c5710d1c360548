"""Connected components of links by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.shared import settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is its component's smallest node.

    Each round joins links with their nodes' smallest neighbours, so a node with many links is
    split like any skewed join key, and writes what is left. The number of rounds grows with
    the logarithm of the components' size.
    """
    edges = settled(_pairs(links.select("a", "b")), "links")
    known = None
    while True:
        edges = settled(_small_star(_large_star(edges)), "links")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == known:
            break
        known = found
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _pairs(links: DataFrame) -> DataFrame:
    """Each link once, the larger node first."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return _pairs(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _pairs(moved.unionByName(least.withColumnRenamed("m", "b")))
