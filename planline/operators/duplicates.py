"""Copies among rings: one shape, one place, one area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.functions import geometry as G
from planline.operators import spatial, windows
from planline.operators.graph import checkpointed, connected_components, shuffled


def shapes(rings: DataFrame) -> DataFrame:
    """(handle, layer, area, key, x, y) of rings (handle, layer, ring): shape key, centroid and area; rings without area are left out."""
    # long expressions, worked out once
    c = G.centroid(F.col("ring"))
    rings = rings.select("handle", "layer", "ring").repartition("handle")  # one small file is one task
    out = rings.select("handle", "layer", F.abs(G.signed_area(F.col("ring"))).alias("area"), G.shape_key(F.col("ring")).alias("key"), c.alias("c"))
    return checkpointed(out).where("c is not null").select("handle", "layer", "area", "key", "c.x", "c.y")


def coincident(rings: DataFrame, tolerance: float) -> DataFrame:
    """(handle, first): rings that are copies of another, and the least handle of their group.

    Copies have one shape key, centroids at most ``tolerance`` apart and areas that
    differ by its square at most. Rings at one place are one point from the start.
    """
    s = shapes(rings).withColumns({"x6": F.round("x", 6), "y6": F.round("y", 6), "a6": F.round("area", 6)})
    place = s.groupBy("key", "x6", "y6", "a6").agg(F.min("handle").alias("handle"), F.count(F.lit(1)).alias("n"))
    spots = place.select("handle", "key", F.col("a6").alias("area"), F.col("x6").alias("x"), F.col("y6").alias("y"))
    near = spatial.within_radius(spots, spots, tolerance, ["key"]).where("c_handle < o_handle")
    near = near.where(F.abs(F.col("c_area") - F.col("o_area")) <= tolerance * tolerance)
    edges = near.select(F.col("c_handle").alias("a"), F.col("o_handle").alias("b"))
    group = connected_components(place.select(F.col("handle").alias("node")), edges)
    placed = place.join(shuffled(group), F.col("handle") == F.col("node")).select("key", "x6", "y6", "a6", F.col("component").alias("first"))
    out = s.join(shuffled(placed), ["key", "x6", "y6", "a6"]).select("handle", "first")
    several = out.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("first")
    return out.join(shuffled(several), "first").select("handle", "first")


def modal_edges(rings: DataFrame) -> DataFrame:
    """(key, edges, times, n): for each shape its most frequent edge lengths (a whole tuple, rounded to 6), the least on a tie."""
    edges = F.transform(G.edge_lengths(F.col("ring")), lambda e: F.round(e, 6))
    rings = rings.select("handle", "ring").repartition("handle")  # one small file is one task
    counts = rings.select(G.shape_key(F.col("ring")).alias("key"), edges.alias("edges")).groupBy("key", "edges").agg(F.count(F.lit(1)).alias("times"))
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("times")).alias("rank"), "edges")).alias("b"), F.sum("times").alias("n"))
    return best.select("key", "b.edges", (-F.col("b.rank")).alias("times"), "n")


def same_label(labels: DataFrame) -> DataFrame:
    """(ring, text, n): texts, trimmed and without case, that stand several times in one ring (labels: ring, text)."""
    text = F.lower(F.trim("text"))
    return labels.where(text != "").groupBy("ring", text.alias("text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def size_groups(bodies: DataFrame, relative: float = 1e-6) -> DataFrame:
    """(body, group): bodies (body, entities, width, height) of equal number and, within ``relative``, equal width and height.

    A body whose width or height exceeds the one before it in order by more than that
    begins a new group; single entities and boxes without extent are left out.
    """
    some = bodies.where("entities > 1 and (width > 0 or height > 0)")

    def runs(df: DataFrame, group: list[str], size: str) -> DataFrame:
        scaled = df.withColumn("low", F.log(F.greatest(F.col(size), F.lit(1e-300)))).withColumn("high", F.col("low"))
        return windows.islands(scaled, group, "low", "high", ["body"], relative).withColumnRenamed("island", f"{size}_run").drop("low", "high")

    keys = ["entities", "width_run", "height_run"]
    grouped = runs(runs(some, ["entities"], "width"), ["entities", "width_run"], "height")
    least = grouped.groupBy(*keys).agg(F.min("body").alias("group"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.join(least, keys).select("body", "group")
