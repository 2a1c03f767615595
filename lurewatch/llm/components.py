"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)`` that is not the smallest of its component.

    Every round hangs the larger neighbours of a node on its smallest one, then a node's smaller
    neighbours on the smallest; the number of rounds grows with the logarithm of the size of a
    component.  Minima are taken before rows move, and each round is written to the shared folder.
    Equal ends and repeated links do no harm; without links the result is empty.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = stage(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
