"""Ground by how many rings cover it: exact areas of unions and gaps, by tiles and slabs.

A tile is cut into vertical slabs at every vertex and every crossing of edges in it, with
each other and with the tile's floor and ceiling. Inside a slab every length across it
changes linearly, so its middle tells its area. All of it is joins and windows over keys of a tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planline.operators.graph import checkpointed

#: Tiles with more edges are split in four, until that has so many times left more than
#: STALLED of the edges in a part: edges that lie on one another cannot be parted.
EDGES_OF_TILE, STALLED, MOST_STALLS = 48, 0.75, 4


def _filed(edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """Edges of a ring in each tile (t, tx, ty, size) of its own: those whose columns meet, at any height."""
    near = edges.join(tiles, "ring")
    return near.where((F.col("x1") < (F.col("tx") + 1) * F.col("size")) & (F.col("x2") > F.col("tx") * F.col("size")))


def _tiles(rings: DataFrame, size: float) -> DataFrame:
    """ring, size, tx, ty and the ring's box: the tiles that each ring's box meets."""
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long")))
    return rings.withColumn("size", F.lit(float(size))).withColumn("tx", span("minx", "maxx")).withColumn("ty", span("miny", "maxy"))


def covered_slabs(rings: DataFrame, size: float) -> DataFrame:
    """Strips of ground: ``area`` and, for each value of ``side``, how many of its rings lie over it.

    ``rings``: ring (id), side (0 or 1), points array<struct<x,y>>, even-odd inside. Equal
    rings are combined to one that counts as many. Tiles of width ``size`` are split while
    they hold more than EDGES_OF_TILE edges and that parts them, so a crowded place is many
    tiles. Returns depth0, depth1, area.
    """
    rings = rings.groupBy("side", "points").agg(F.min("ring").alias("ring"), F.count(F.lit(1)).alias("times"))
    after = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    pairs = F.arrays_zip(F.col("points").alias("p"), after.alias("q"))
    edges = rings.where(F.size("points") >= 3).select("ring", "side", "times", F.explode(pairs).alias("e"))
    p, q = F.col("e.p"), F.col("e.q")
    swap = p["x"] > q["x"]
    pick = lambda a, b, c: F.when(swap, b[c]).otherwise(a[c])
    edges = edges.where(p["x"] != q["x"]).select(
        "ring", "side", "times", pick(p, q, "x").alias("x1"), pick(p, q, "y").alias("y1"), pick(q, p, "x").alias("x2"), pick(q, p, "y").alias("y2")
    )
    edges = checkpointed(edges)
    boxes = edges.groupBy("ring").agg(
        F.min("x1").alias("minx"), F.max("x2").alias("maxx"), F.min(F.least("y1", "y2")).alias("miny"), F.max(F.greatest("y1", "y2")).alias("maxy")
    )
    tiles = _tiles(boxes, size).withColumns({"stalls": F.lit(0), "above": F.lit(None).cast("long")})
    key, done = ["size", "tx", "ty"], None
    while True:
        filed = checkpointed(_filed(edges, tiles))
        counts = filed.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.max("above").alias("was"), F.max("stalls").alias("stalls"))
        stalls = F.col("stalls") + F.coalesce(F.col("held") > STALLED * F.col("was"), F.lit(False)).cast("int")
        crowded = checkpointed(counts.select(*key, F.col("held").alias("above"), stalls.alias("stalls")).where((F.col("above") > EDGES_OF_TILE) & (F.col("stalls") < MOST_STALLS)))
        fine = filed.join(crowded, key, "left_anti").drop("minx", "maxx", "miny", "maxy", "stalls", "above")
        done = fine if done is None else done.unionByName(fine)
        if crowded.isEmpty():
            break
        parts = tiles.drop("stalls", "above").join(crowded, key).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(3))))
        parts = parts.withColumns({"size": F.col("size") / 2, "tx": F.col("tx") * 2 + F.col("h") % 2, "ty": F.col("ty") * 2 + F.floor(F.col("h") / 2)}).drop("h")
        wide = (F.col("minx") < (F.col("tx") + 1) * F.col("size")) & (F.col("maxx") > F.col("tx") * F.col("size"))
        tall = (F.col("miny") < (F.col("ty") + 1) * F.col("size")) & (F.col("maxy") > F.col("ty") * F.col("size"))
        tiles = checkpointed(parts.where(wide & tall))
    return _slabs(done)


def _slabs(filed: DataFrame) -> DataFrame:
    key = ["size", "tx", "ty"]
    left, right = F.col("tx") * F.col("size"), (F.col("tx") + 1) * F.col("size")
    low, high = F.col("ty") * F.col("size"), (F.col("ty") + 1) * F.col("size")
    flat = filed.withColumn("slope", (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    a = flat.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("ring", "x1", "y1", "x2", "slope")])
    b = flat.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("ring", "x1", "y1", "x2", "slope")])
    differ = F.nullif(F.col("a_slope") - F.col("b_slope"), F.lit(0.0))
    x = (F.col("b_y1") - F.col("a_y1") + F.col("a_slope") * F.col("a_x1") - F.col("b_slope") * F.col("b_x1")) / differ
    once = F.struct("a_ring", "a_x1", "a_y1", "a_x2") < F.struct("b_ring", "b_x1", "b_y1", "b_x2")
    crossings = a.join(b, key).where(once).withColumn("x", x).where(
        (F.col("x") > F.greatest("a_x1", "b_x1")) & (F.col("x") < F.least("a_x2", "b_x2"))
    )
    # where an edge leaves the tile through its floor or ceiling, lengths in the tile turn a corner too
    level = lambda y: F.col("x1") + (y - F.col("y1")) / F.nullif(F.col("slope"), F.lit(0.0))
    leaves = [F.when(level(y).between(F.col("x1"), F.col("x2")), level(y)) for y in (low, high)]
    at = flat.select(*key, F.explode(F.array_compact(F.array("x1", "x2", left, right, *leaves))).alias("x"))
    cuts = at.unionByName(crossings.select(*key, "x")).where((F.col("x") >= left) & (F.col("x") <= right)).distinct()
    slabs = cuts.withColumn("next", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("next > x")
    slabs = slabs.select(*key, F.col("x").alias("from"), (F.col("next") - F.col("x")).alias("width"), ((F.col("x") + F.col("next")) / 2).alias("middle"))
    over = flat.join(slabs, key).where((F.col("x1") < F.col("middle")) & (F.col("x2") > F.col("middle")))
    y = F.col("y1") + F.col("slope") * (F.col("middle") - F.col("x1"))
    over = over.withColumn("y", F.greatest(low, F.least(high, y)))
    slab = [*key, "from", "width"]
    turn = F.col("times") * F.when(F.row_number().over(Window.partitionBy(*slab, "ring", "side").orderBy("y")) % 2 == 1, 1).otherwise(-1)
    steps = over.select(*slab, "side", "y", turn.alias("turn")).groupBy(*slab, "y").agg(
        F.sum(F.when(F.col("side") == 0, F.col("turn")).otherwise(0)).alias("turn0"), F.sum(F.when(F.col("side") == 1, F.col("turn")).otherwise(0)).alias("turn1")
    )
    up = Window.partitionBy(*slab).orderBy("y")
    runs = steps.select("width", F.lead("y").over(up).alias("top"), "y", F.sum("turn0").over(up).alias("depth0"), F.sum("turn1").over(up).alias("depth1"))
    return runs.where("top > y").select("depth0", "depth1", ((F.col("top") - F.col("y")) * F.col("width")).alias("area")).where("depth0 > 0 or depth1 > 0")


def gap_block(claims: DataFrame, boundary: DataFrame, size: float) -> DataFrame:
    """One row: ground inside the boundary, what of it is claimed once or more, what is shared, and the gap.

    Rings of ``claims`` and of ``boundary`` (ring, points) may overlap each other at will: each
    piece of ground counts once, however many rings lie over it. Without a boundary ring the
    gap is not computed (null), for an outline taken from the claims would leave none.
    """
    both = claims.select("ring", F.lit(0).alias("side"), "points").unionByName(boundary.select((-F.col("ring") - 1).alias("ring"), F.lit(1).alias("side"), "points"))
    s = covered_slabs(both, size)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("area"))), F.lit(0.0))
    inside, claimed = F.col("depth1") > 0, F.col("depth0") > 0
    sums = s.agg(
        total(inside).alias("boundary_area"), total(inside & claimed).alias("covered_area"), total(inside & (F.col("depth0") > 1)).alias("shared_area"),
        total(claimed & ~inside).alias("claimed_outside"), total(inside & ~claimed).alias("gap"),
    )
    return sums.select("boundary_area", "covered_area", "shared_area", "claimed_outside", F.when(F.col("boundary_area") > 0, F.col("gap")).alias("gap_area"))
