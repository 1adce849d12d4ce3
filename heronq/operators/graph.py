"""Connected components of a table of links, and what links lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.sources.scratch import settled


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, component): each node of a link with the least node that links reach from it.

    Every round hangs a node's greater neighbours on its least neighbour, then its lesser ones, until all hang on roots. A round is two
    aggregates with partial sums and two equi-joins with their written results, whose hot keys the engine can split. Links of a node
    with itself and repeated links change nothing; links with a null end are none; no links give no rows.
    """
    ends = links.where("a is not null and b is not null")
    edges = settled(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct(), "edges")
    for _ in range(most_rounds):
        parents = edges.groupBy("hi").agg(F.count("*").alias("n"))
        if not parents.where("n > 1").head(1) and not edges.join(parents.select(F.col("hi").alias("lo")), "lo", "left_semi").head(1):
            nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return nodes.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        around = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("at", "other")
        least = settled(around.groupBy("at").agg(F.least("at", F.min("other")).alias("m")), "least")
        raised = around.where("other > at").join(least, "at").select(F.col("other").alias("hi"), F.col("m").alias("lo"))
        edges = settled(raised.distinct(), "raised")
        least = settled(edges.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        lowered = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = settled(lowered.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "lowered")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def reachable(links: DataFrame, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """links (a, b), seeds (node) -> (node, hops): the seeds and all that links lead to from any of them, with the fewest links.

    Each round joins only the nodes that the last one found, and keeps those not known before, so cycles end; it stops when none
    is new. Links with null ends lead nowhere, null seeds are none; repeated links and seeds change nothing; no seeds give no rows.
    """
    links = settled(links.where("a is not null and b is not null").distinct(), "links")
    fresh = settled(seeds.where("node is not null").distinct().withColumn("hops", F.lit(0).cast("long")), "found")
    known = fresh
    for turn in range(1, most_rounds + 1):
        if not fresh.head(1):
            return known
        there = links.join(fresh.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        fresh = settled(there.join(known, "node", "left_anti").withColumn("hops", F.lit(turn).cast("long")), "found")
        known = settled(known.unionByName(fresh), "known") if turn % 16 == 0 else known.unionByName(fresh)
    raise RuntimeError(f"more than {most_rounds} rounds")
