"""Connected components of a link table by repeated star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _crossed(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one; else each component is a star around its smallest node."""
    up, down = (F.lit(x).alias("up") for x in (1, 0)), (F.lit(x).alias("down") for x in (0, 1))
    ends = [edges.select(F.col(end).alias("node"), *kinds) for end, *kinds in zip("xy", up, down, strict=True)]
    nodes = ends[0].union(ends[1]).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0] > 0


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node reachable.

    Each round points every node at the smallest neighbour of its neighbourhood (large and small stars in turn),
    so stars of any size take partial minima only and chains shrink by half or better; the state is written
    to the shared folder after each round. Ends when only stars are left, which further rounds would not change.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    while _crossed(edges):
        # large star: larger neighbours go to the smallest of the closed neighbourhood
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = (
            both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        )
        # small star: smaller neighbours, and the node itself, go to the smallest
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(lowest, "x")
            .select(F.explode(F.array("x", "y")).alias("x"), F.col("m").alias("y"))
            .filter("x != y")
            .distinct()
        )
        new = stored(small, "edges")
        discard(edges)
        edges = new
    roots = edges.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("comp")).union(roots)
