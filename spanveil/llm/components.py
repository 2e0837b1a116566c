"""Connected components of an edge table, by alternating large-star and small-star steps; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b): the label is the smallest node of the component.

    Self loops and repeated edges are fine. Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest path.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        # large star: every larger neighbour is tied to the smallest of the neighbourhood, node included
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "components")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "components")
        discard(least, now)
        # small star: the smaller neighbours and the node are tied to the smallest of them
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        joined = large.join(least, "a")
        now = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = materialise(now, "components")
        discard(least, large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
