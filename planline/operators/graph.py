"""Components, reachability and revision differences."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the folder that ``spark.checkpoint.dir`` names; a session on one machine may name none."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = base or "file://" + tempfile.mkdtemp(prefix="planline-")
        spark.sparkContext.setCheckpointDir(f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}")
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join by key that grows with the input: both sides are dealt by key.

    Spark guesses a side's size from its compressed files, and a few megabytes of keys
    become gigabytes of cells and rings; a side guessed too small would go through the
    driver and whole into every task.
    """
    return df.hint("merge")


class Levels:
    """Rows that a loop finds level by level, each kept in the shared folder once and merged seldom.

    Eight parts of a rank become one of the next, so a row is written anew about once for
    each power of eight of the levels and the plan stays short.
    """

    def __init__(self) -> None:
        self._parts: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame, rank: int = 0) -> None:
        """``rows``: already checkpointed."""
        self._parts.append((rank, rows))
        same = [part for r, part in self._parts if r == rank]
        if len(same) == 8:
            self._parts = [x for x in self._parts if x[0] != rank]
            self.add(checkpointed(reduce(DataFrame.unionByName, same)), rank + 1)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [part for _, part in self._parts])


def forgotten(df: DataFrame) -> None:
    """Delete the files of :func:`checkpointed` rows that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b) either way; a node without an edge is its own."""
    return nodes.select("node").join(shuffled(linked(edges)), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def linked(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that edges (a, b) lead from or to: the least node reachable either way.

    Pairs that hang on nothing else are settled at once; only what is left goes round:
    labels fall to the least neighbour's, and then to that label's own label, so paths
    halve in each round. Every round is checkpointed in the shared folder, and the last
    one's files are deleted then.
    """
    apart = edges.where("a <> b")
    # both ways from one row, so that what finds the edges runs once
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    every = checkpointed(apart.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    degrees = every.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("low"))
    other = degrees.select(F.col("a").alias("low"), F.col("degree").alias("low_degree"))
    pair = (F.col("degree") == 1) & (F.col("low_degree") == 1)
    known = checkpointed(degrees.join(shuffled(other), "low").select(F.col("a").alias("node"), F.when(pair, F.least("a", "low")).alias("component")))
    settled = known.where("component is not null")
    label = known.where("component is null").select("node", F.col("node").alias("component"))
    if not label.limit(1).count():
        forgotten(every)
        return settled
    label = last = checkpointed(label)
    both = checkpointed(every.join(shuffled(label.select(F.col("node").alias("a"))), "a", "left_semi"))
    forgotten(every)
    while True:
        near = both.join(shuffled(label), both.b == label.node).groupBy("a").agg(F.min("component").alias("low"))
        fresh = label.join(shuffled(near), label.node == near.a, "left").select("node", "component", F.least("component", F.coalesce("low", "component")).alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("next"))
        after = fresh.join(shuffled(jump), "low", "left").select("node", F.coalesce("next", "low").alias("after"), "component")
        after = checkpointed(after)
        forgotten(last)
        changed = after.where("after <> component").limit(1).count()
        label, last = after.select("node", F.col("after").alias("component")), after
        if not changed:
            forgotten(both)
            return settled.unionByName(label)


def reachable(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all nodes reachable from roots over directed edges (a, b), roots included.

    Each round takes one step from the nodes found last and keeps those not yet reached,
    until there are none; every round is checkpointed in the shared folder.
    """
    edges = checkpointed(edges.select("a", "b").distinct())
    last, depth = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0))), 0
    reached = Levels()
    reached.add(last)
    while True:
        depth += 1
        step = edges.join(shuffled(last.select(F.col("node").alias("a"))), "a").select(F.col("b").alias("next")).distinct()
        fresh = step.join(shuffled(reached.all().select("node")), F.col("next").eqNullSafe(F.col("node")), "left_anti")
        last = checkpointed(fresh.select(F.col("next").alias("node"), F.lit(depth).alias("depth")))
        if not last.limit(1).count():
            return reached.all()
        reached.add(last)



def revision(before: DataFrame, after: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison by keys: added, removed, changed or same, with the difference."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("in_before"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(1).alias("in_after"))
    both = a.join(b, keys, "full_outer")
    status = (
        F.when(F.col("in_before").isNull(), "added")
        .when(F.col("in_after").isNull(), "removed")
        .when(F.coalesce(F.abs(F.col("after") - F.col("before")) <= tolerance, F.col("before").isNull() & F.col("after").isNull()), "same")
        .otherwise("changed")
    )
    return both.select(*keys, "before", "after", status.alias("status"), F.round(F.col("after") - F.col("before"), 4).alias("delta"))
