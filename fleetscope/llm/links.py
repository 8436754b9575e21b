"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.runtime import cut_lineage


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for each node of ``links`` that is not the smallest of its component.

    ``links`` holds two columns of one orderable type; loops and repeats do no harm. Each
    round points all neighbours of a node to their smallest (large star), then each node's
    smaller neighbours (small star); rounds grow with the logarithm of the longest path.
    Nodes with many links meet only partial minima and joins that Spark can split; no
    neighbourhood is gathered. Every round is a reliable checkpoint.
    """
    links = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(links)
    while before[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.union(least).distinct())
        after = _digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
