"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketline.staging import stage


def _digest(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b), the smallest node naming it.

    Alternates large-star and small-star steps, which keep the components and end with
    every node pointing at the smallest. Nodes compare as longs. Each pass is written
    to the shared folder, so a lost executor never repeats the passes before. The number
    of passes grows with the logarithm of the graph, not with its longest path.
    """
    oriented = edges.where("a != b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    now = stage(oriented.distinct(), "edges")
    before, digest = None, _digest(now)
    while digest != before and digest[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: a node's larger neighbours move to its smallest neighbour or itself.
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            now.select(F.col("b").alias("a"), F.col("a").alias("b"))
            .join(smallest, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .where("a != b")
            .distinct()
        )
        now = stage(small, "edges")
        before, digest = digest, _digest(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
