"""Connected components of an edge table, by alternating large-star and small-star steps.

Neither step gathers a node's neighbours: minima come from partial aggregation and go back by a join. Those of nodes with more than ``HUB`` neighbours, and than a
``HUBS``-th part of all, are broadcast, at most 2 * ``HUBS`` rows whatever the table's size; so a node with very many neighbours is no hot task. Every step's result is a
table in the shared folder; nothing but a count and a checksum reaches the driver.

Defined results: repeated edges and edges from a node to itself count for nothing; null nodes have no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.common import remove, save


HUB, HUBS = 500, 100_000


def _beside(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with the row of ``least`` (a, m, n) of their node a."""
    limit = max(HUB, total // HUBS)
    hubs = F.broadcast(least.filter(F.col("n") > limit).drop("n"))
    rest = edges.join(hubs.select("a"), "a", "left_anti").join(least.filter(F.col("n") <= limit).drop("n"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Of (a, b) with long nodes: (node, root), root being the component's smallest node; roots and lone nodes have no row."""
    spark = edges.sparkSession
    now = save(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == mark or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = sign
        both = now.union(now.select("b", "a"))
        least = save(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "large-least")
        large = save(_beside(both, least, 2 * sign[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        remove(spark, least)
        least = save(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "small-least")
        small = _beside(large, least, 2 * sign[0]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(small.union(least.select("a", "m")).distinct(), "small-star")
        remove(spark, now, large, least)
        now = after
