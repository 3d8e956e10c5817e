"""Connected components by alternating large and small stars, on edges of any comparable key; nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import drop_table, lookup, materialise


def stars(edges: DataFrame) -> DataFrame:
    """One round: large star, then small star; edges (a, b) with b < a. A hub's edges are looked up without a shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).select("a", F.least("a", "m").alias("m"), "size"), "near")
    large = lookup(both, near, "a", "size", 2 * edges.count()).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = materialise(large, "large")
    least = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")), "least")
    small = lookup(large, least, "a", "size", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest key of node's component; nodes without an edge to another aren't listed.

    edges: columns a and b, in any direction. Each round is written to the shared folder, so a lost executor costs one round.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        # Done when every node points at one root, and no root points on: sums that combine before they shuffle.
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("x"), F.lit(1).alias("y")))
        loose = ends.groupBy("n").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x > 1 OR (x > 0 AND y > 0)").limit(1).count()
        if not loose:
            break
        before, now = now, materialise(stars(now), "edges")
        drop_table(before)
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
