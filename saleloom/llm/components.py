"""Connected components of an edge table, by stars: every edge set shrinks to one star per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleloom.session import discard, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest of node and neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (near.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of these neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots; root is the smallest node of its component.

    ``edges`` has columns a and b. Loops are ignored; an edge may stand in any direction and more
    than once. Every round is one written table, which goes when the next one is written; the driver sees
    two numbers of it.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter("a > b").distinct(), "stars")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        last, now = now, stored(_small_star(_large_star(now)), "stars")
        discard(last)
