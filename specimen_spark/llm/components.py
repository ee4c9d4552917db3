"""Connected components by alternating star contraction, in DataFrame operations only.

Every node is linked to the smallest node it knows of; after a few rounds, as many as the logarithm of the
longest path, the edges are stars around the smallest node of each component. A node's neighbours are never
gathered: each round is a minimum per node and a join that adaptive execution can split for hot nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.operators.keyed import attach
from specimen_spark.session import cut_lineage


def star_round(edges: DataFrame) -> DataFrame:
    """One contraction of edges (a, b) with a > b; links away from the smallest node become links to it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (
        attach(both, least, ["a"]).where("b > a")
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a > b").distinct()
    )
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = attach(large, lowest, ["a"]).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b) but the smallest of each component; no order of a and b needed.

    Null ends, loops and repeated edges are left out. The loop ends when a round changes nothing, which two
    numbers tell the driver.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        edges = cut_lineage(star_round(edges))
