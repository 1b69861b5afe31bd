"""Connected components of a link table, by alternating large and small stars.

Each round is joins and grouped minima, so a node with very many links is an ordinary hot key that partial
aggregation and skew-joins take; no component is ever held by one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import gathered


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; a component is named by its least node.

    Links to oneself and repeated links do no harm; null ends are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = gathered(edges)
    while True:
        edges = gathered(_small_star(_large_star(edges).distinct()).where("u <> v").distinct())
        # Done when all links lead to a node that has none itself: only stars are left.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionAll(edges.select("v", F.lit(0)))
        if ends.groupBy("node").agg(F.min("out").alias("l"), F.max("out").alias("m")).where("l <> m").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
