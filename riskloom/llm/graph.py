"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each round links the neighbours of a node to the smallest
    of them, which roughly squares the reach. Every round is one aggregation and one join on the node; hot
    nodes are pre-aggregated and their join partitions are split at run time. A round's edges are written
    to the shared folder, so a lost executor costs one round. Raises if ``rounds`` do not suffice.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            # Each node hangs on one root now, and roots hang on none.
            roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = now
    raise RuntimeError(f"components not settled after {rounds} rounds")
