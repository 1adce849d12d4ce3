"""Connected components of an edge table, with no group ever gathered in a task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import discard, settle


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node that edges reach, for each node of an edge.

    Alternates large-star and small-star steps until every node hangs on one that hangs on none. A step is an
    aggregate with partial sums (the least neighbour), written out, and an equi-join of the edges with it: as neither
    side of that join is an aggregate, the engine can split a node with a third of all edges. Self loops and
    repeats are harmless; no edges give no rows.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        # large star: every greater neighbour of a node joins the node's least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large")
        discard(least)
        # small star: a node and its lesser neighbours join the least of these
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        new = settle(small.distinct(), "small")
        for done in (large, least, now):
            discard(done)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").head(1)
