"""Blocks and their inserts: how often each is drawn, and where.

Inserts are rows of container, block, and the move of the insert: x, y, angle (radians),
sx, sy. A container is a layout or a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.errors import Refusal
from planline.operators.graph import Levels, checkpointed, reachable, shuffled

#: A block's own frame, column by column: x' = a x + c y + e, y' = b x + d y + f.
MATRIX = ("a", "b", "c", "d", "e", "f")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Drawings seldom nest deeper; from here on circles are looked for before going on.
DEEP = 8


def refuse_circles(edges: DataFrame, roots: DataFrame) -> None:
    """Refuse where blocks below a root (``root``) insert one another in a circle.

    Inserts (container, block) of blocks that hold no inserts are taken away until that
    takes none away; what is left leads into a circle. A round for each level of nesting.
    """
    left = edges.select("container", "block")
    count = left.count()
    while count:
        inner = checkpointed(left.join(shuffled(left.select(F.col("container").alias("block")).distinct()), "block", "left_semi"))
        kept = inner.count()
        if kept == count:
            reached = reachable(edges.sparkSession, edges.select(F.col("container").alias("a"), F.col("block").alias("b")), roots.select(F.col("root").alias("node")))
            if left.join(shuffled(reached), left["container"] == reached["node"], "left_semi").limit(1).count():
                raise Refusal("circular_inserts", "blocks insert one another in a circle", "mend the drawing")
            return
        left, count = inner, kept


def multiplicity(inserts: DataFrame, roots: DataFrame, blocks: int) -> DataFrame:
    """(root, block, times): how often each block is drawn below each root once all inserts are followed.

    A block may be drawn along many ways; equal ones are summed at each level, so no way
    is listed. ``blocks``: their number; a chain longer than that runs in a circle and is
    refused.
    """
    edges = checkpointed(inserts.groupBy("container", "block").agg(F.count(F.lit(1)).alias("n")))
    level = checkpointed(roots.select(F.col("root"), F.col("root").alias("block"), F.lit(1).cast("decimal(38,0)").alias("times")))
    out = Levels()
    out.add(level)
    for depth in range(blocks + 1):
        if depth == DEEP:
            refuse_circles(edges, roots)
        step = level.withColumnRenamed("block", "container").join(shuffled(edges), "container").select("root", "block", F.try_multiply("times", F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)").alias("times"))
        # a sum is null where it has no room, and so are the products that go into it
        level = checkpointed(step.groupBy("root", "block").agg(F.when(F.count_if(F.col("times").isNull()) == 0, F.try_sum("times")).cast("decimal(38,0)").alias("times")))
        found = level.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("times").isNull()).alias("beyond")).first()
        if found.beyond:
            raise Refusal("too_many_copies", "a block is drawn more often than 38 digits can say", "mend the drawing")
        if not found.rows:
            return out.all().groupBy("root", "block").agg(F.sum("times").cast("decimal(38,0)").alias("times"))
        out.add(level)
    raise Refusal("circular_inserts", "blocks insert one another in a circle", "mend the drawing")


def expanded_counts(entities: DataFrame, inserts: DataFrame, roots: DataFrame, blocks: int) -> DataFrame:
    """(root, entities): objects drawn below each root; the inserts themselves do not count (entities: container)."""
    own = entities.groupBy(F.col("container").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    drawn = multiplicity(inserts, roots, blocks).join(shuffled(own), "block")
    return drawn.groupBy("root").agg(F.sum(F.col("times") * F.col("n")).cast("long").alias("entities"))


def _after(outer: str, inner: str) -> list:
    """The matrix of ``inner`` drawn inside ``outer``."""
    o, i = ({m: F.col(f"{side}{m}") for m in MATRIX} for side in (outer, inner))
    return [
        (o["a"] * i["a"] + o["c"] * i["b"]).alias("a"), (o["b"] * i["a"] + o["d"] * i["b"]).alias("b"),
        (o["a"] * i["c"] + o["c"] * i["d"]).alias("c"), (o["b"] * i["c"] + o["d"] * i["d"]).alias("d"),
        (o["a"] * i["e"] + o["c"] * i["f"] + o["e"]).alias("e"), (o["b"] * i["e"] + o["d"] * i["f"] + o["f"]).alias("f"),
    ]


def with_matrix(inserts: DataFrame) -> DataFrame:
    """(container, block, i_a ... i_f): the insert's scale, turn and move as one matrix."""
    cos, sin = F.cos("angle"), F.sin("angle")
    columns = (cos * F.col("sx"), sin * F.col("sx"), -sin * F.col("sy"), cos * F.col("sy"), F.col("x"), F.col("y"))
    return inserts.select("container", "block", *[F.round(c, 9).alias(f"i_{m}") for c, m in zip(columns, MATRIX)])


def placements(inserts: DataFrame, roots: DataFrame, blocks: int) -> DataFrame:
    """(block, placements, status, a ... f): how each block stands in the roots' frame.

    ``identity``: everywhere as it is defined; ``placed``: in one other way, whose matrix
    is given; ``ambiguous``: in several. Equal placements are one at each level.
    """
    edges = checkpointed(with_matrix(inserts).distinct())
    start = [F.lit(v).alias(m) for v, m in zip(IDENTITY, MATRIX)]
    level = checkpointed(roots.select(F.col("root").alias("block"), *start).distinct())
    out, none = Levels(), True
    for depth in range(blocks + 1):
        if depth == DEEP:
            refuse_circles(edges, roots)
        outer = level.select(F.col("block").alias("at"), *[F.col(m).alias(f"o_{m}") for m in MATRIX])
        step = outer.join(shuffled(edges), F.col("at") == F.col("container")).select("block", *_after("o_", "i_"))
        level = checkpointed(step.select("block", *[F.round(m, 6).alias(m) for m in MATRIX]).distinct())
        if not level.limit(1).count():
            break
        out.add(level)
        none = False
    else:
        raise Refusal("circular_inserts", "blocks insert one another in a circle", "mend the drawing")
    if none:
        return inserts.select("block", F.lit(0).cast("long").alias("placements"), F.lit("").alias("status"), *start).limit(0)
    same = F.lit(True)
    for v, m in zip(IDENTITY, MATRIX):
        same = same & (F.abs(F.col(m) - v) <= 1e-6)
    g = out.all().distinct().groupBy("block").agg(F.count(F.lit(1)).alias("placements"), F.bool_and(same).alias("same"), F.min(F.struct(*MATRIX)).alias("m"))
    status = F.when(F.col("same"), "identity").when(F.col("placements") == 1, "placed").otherwise("ambiguous")
    one = [F.when(F.col("placements") == 1, F.col(f"m.{m}")).alias(m) for m in MATRIX]
    return g.select("block", "placements", status.alias("status"), *one)


def world_placed(entities: DataFrame, placed: DataFrame, extents: tuple[float, float, float, float] | None) -> DataFrame:
    """Entities with ``space`` and ``world``: whether their own coordinates are positions of the drawing.

    ``entities``: container, in_block (its container is a block), x, y. ``placed``: from
    :func:`placements`. What stands in a layout does; what stands in a block does where
    every way to that block leaves it as it is defined, for then nothing is to be moved.
    A block placed as defined in one spot and moved in another is neither, and so is one
    that is never placed. Extents (minx, miny, maxx, maxy) only corroborate: a point beyond
    them, or none, is refused, and without extents nothing in a block is placed.
    """
    rows = entities.join(shuffled(placed.select(F.col("block").alias("container"), "status")), "container", "left")
    inside = F.lit(False)
    if extents is not None:
        inside = F.coalesce(F.col("x").between(extents[0], extents[2]) & F.col("y").between(extents[1], extents[3]), F.lit(False))
    world = F.when(F.col("in_block"), (F.coalesce("status", F.lit("")) == "identity") & inside).otherwise(True)
    space = F.when(~F.col("in_block"), "layout").when(F.col("status").isNull(), "unplaced").otherwise(F.col("status"))
    return rows.withColumns({"space": space, "world": world}).drop("status")


def in_scope(rows: DataFrame, layout: str, model: str = "Model") -> DataFrame:
    """Rows of :func:`world_placed` that a view of a layout shows: a sheet its own, the model also all that is placed in the world."""
    own = ~F.col("in_block") & (F.col("container") == layout)
    return rows.where(own | (F.col("in_block") & F.col("world")) if layout == model else own)
