"""Detached bodies of a layer, which of them are copies of one another, and which copy is in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.operators import spatial, windows
from planline.operators.graph import checkpointed

CORNERS = ("minx", "miny", "maxx", "maxy")


def bodies(df: DataFrame, group: str) -> DataFrame:
    """(group, handle, body, threshold and the box): rows of a group cut where a void is wider than its widest feature.

    Cuts by x and by y take turns within what the last cut left, until a round cuts
    nothing, so bodies behind one another are found at any depth. A void wider than the
    widest feature cannot lie inside a feature. ``body`` is the least handle of a body.
    Rows without a box have no place and are left out.
    """
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    placed = df.where("minx is not null and miny is not null and maxx is not null and maxy is not null").select(group, "handle", *CORNERS)
    widest = placed.groupBy(group).agg(F.max(extent).alias("threshold"), F.min("handle").alias("body"))
    now = checkpointed(placed.join(widest, group))
    before = -1
    while True:
        for low, high in (("minx", "maxx"), ("miny", "maxy")):
            cut = windows.islands(now, [group, "body"], low, high, ["handle"], F.col("threshold"))
            least = cut.groupBy(group, F.col("body").alias("was"), "island").agg(F.min("handle").alias("body"))
            cut = cut.withColumnRenamed("body", "was").join(least, [group, "was", "island"])
            now = checkpointed(cut.select(group, "handle", *CORNERS, "threshold", "body"))
        count = now.select(group, "body").distinct().count()
        if count == before:
            return now
        before = count


def body_summaries(placed: DataFrame, group: str, quantum: float = 1e-6) -> DataFrame:
    """A row for each body: entities, box, and ``shape``, equal for bodies that differ by a shift alone.

    The shape is the count, and sums of hashes, of the members' boxes seen from the body's
    least corner, so that neither order nor place counts.
    """
    box = placed.groupBy(group, "body").agg(
        F.count(F.lit(1)).alias("entities"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )
    members = placed.select(group, "body", *[F.col(c).alias(f"m_{c}") for c in CORNERS]).join(box, [group, "body"])
    from_corner = [F.round((F.col(f"m_{c}") - F.col("min" + c[-1])) / quantum).cast("long") for c in CORNERS]
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *from_corner).cast("decimal(20,0)")).alias(f"sum{seed}")
    sums = members.groupBy(group, "body").agg(part(0), part(1))
    shape = F.concat_ws(":", "entities", "sum0", "sum1")
    return box.join(sums, [group, "body"]).select(group, "body", "entities", *CORNERS, shape.alias("shape"))


def chosen_copies(summaries: DataFrame, others: DataFrame, group: str, cell: float) -> DataFrame:
    """A row for each body with its ``copies`` (bodies of its shape), ``anchors``, ``live`` and the rule that chose.

    ``others``: x and y of what other layers draw, by its least corner. The rest of the drawing lies on the copy in
    use and beside the parked ones, so the body with most of it is live, if it is the only
    one with so many; a lone body is; else none is (``rule``: only, anchors or none).
    """
    boxes = summaries.select(group, "body", *CORNERS)
    held = spatial.points_in_boxes(others.select("x", "y"), boxes, cell).groupBy(F.col(f"r_{group}").alias(group), F.col("r_body").alias("body")).agg(F.count(F.lit(1)).alias("anchors"))
    counted = summaries.join(held, [group, "body"], "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))
    shapes = counted.groupBy(group, "shape").agg(F.count(F.lit(1)).alias("copies"), F.min("body").alias("first_copy"))
    most = counted.groupBy(group).agg(F.max("anchors").alias("most"), F.count(F.lit(1)).alias("bodies"))
    at_most = counted.join(most, group).where("anchors = most").groupBy(group).agg(F.count(F.lit(1)).alias("leaders"))
    rows = counted.join(shapes, [group, "shape"]).join(most, group).join(at_most, group)
    rule = F.when(F.col("bodies") == 1, "only").when((F.col("most") > 0) & (F.col("leaders") == 1), "anchors").otherwise("none")
    live = (rule == "only") | ((rule == "anchors") & (F.col("anchors") == F.col("most")))
    return rows.select(group, "body", "entities", *CORNERS, "copies", "first_copy", "anchors", live.alias("live"), rule.alias("rule"))
