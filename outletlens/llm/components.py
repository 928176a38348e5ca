"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of a link (a, b).

    Each round links every vertex's larger neighbours to its smallest one, then its
    smaller neighbours to it; rounds grow with the logarithm of the longest chain.
    Nothing is collected: the stop test reads one sum. The aggregation is a plain
    minimum with map-side combine, so a hub's list never meets in one task."""
    edges = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0")
    size, before = edges.count(), None
    while True:
        # large star: of each vertex, the neighbours larger than it go to the smallest around it
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = scratch(big, "cc-large", rows=2 * size)
        # small star: of each vertex, the smaller neighbours and it go to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        near = big.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch(small, "cc-small", rows=2 * size)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        size, before = now[0], now
