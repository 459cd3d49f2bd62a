"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b) the smallest node it is connected to.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour; rounds grow
    with the logarithm of a component's size, not with its diameter. Only sums and minima are taken per node, never
    lists, so a node with very many links needs no room. Rounds are written to the shared folder.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        large = large.unionAll(own).where("a <> b").distinct()
        # Now every link goes from a larger to a smaller node.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    rows = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return rows.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Equal for two rounds only if nothing changed: the number of links and sums of hashes of them."""
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"),
        F.sum((F.xxhash64("b", "a") % (1 << 40)).cast("long")).alias("x"),
    ).first()
    return row["n"], row["h"], row["x"]
