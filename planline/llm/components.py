"""Connected components of an edge table, by alternating label steps on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node in edges (a, b).

    Large-star and small-star steps: each node's greater neighbours, then its lesser
    ones, are hung on the least node it sees, until nothing changes. Each round is
    written to the shared folder. Self-edges and nulls are ignored. A hub's edges are
    combined before the shuffle (the least neighbour is an aggregate), and no node's
    neighbours are gathered.
    """
    ordered = edges.where("a is not null and b is not null and a <> b")
    current = written(ordered.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: for each node, hang greater neighbours on its least neighbour or itself
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # small star: each node and its lesser neighbours on the least of them
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        changed = (
            after.exceptAll(current).limit(1).count() + current.exceptAll(after).limit(1).count()
        )
        dropped(current)
        current = after
        if not changed:
            break
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
