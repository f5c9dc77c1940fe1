"""Spatial joins: grid cells as equi-join keys, then the exact test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.errors import refuse_oversize
from planline.functions import geometry as G
from planline.operators.graph import checkpointed, shuffled


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("long")


def _level(cell: float, pad: float = 0.0) -> Column:
    """Grids double in width from ``cell`` on; a box belongs to the first whose cells are as wide as it is."""
    wide = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + 2 * pad
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(wide / cell, F.lit(1.0))))).cast("int")


def _width(cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))


def with_cells(df: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """One row for each grid cell (gx, gy) of its ``level`` that the row's padded box meets: four at most on its own level."""
    xs = F.sequence(_cell(F.col("minx") - pad, _width(cell)), _cell(F.col("maxx") + pad, _width(cell)))
    ys = F.sequence(_cell(F.col("miny") - pad, _width(cell)), _cell(F.col("maxy") + pad, _width(cell)))
    return df.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys))


def _levels(df: DataFrame, cell: float, pad: float = 0.0) -> dict[int, int]:
    """The levels in use and their boxes: some fifty at most, as each doubles the last."""
    counted = df.groupBy(_level(cell, pad).alias("level")).agg(F.count(F.lit(1)).alias("n")).where("level is not null")
    return dict(sorted(tuple(r) for r in counted.collect()))


#: Rows that one task sorts for a join by cells, some 100 MB of them.
TASK_ROWS = 1_000_000


def _dealt(asked: DataFrame, filed: DataFrame, keys: list[str], share: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and their keys, each cell that ``asked`` fills with more than ``TASK_ROWS`` dealt over several ``share``s."""
    shares = F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("shares")
    full = asked.groupBy(*keys).agg(shares).where("shares > 1")
    found = full.collect()  # fewer than the tasks
    if not found:
        return asked, filed, keys
    full = F.broadcast(asked.sparkSession.createDataFrame(found, full.schema))
    hashed = [c for c, kind in asked.dtypes if "map<" not in kind]
    of = F.pmod(F.xxhash64(*hashed), F.col("shares")).cast("int")
    asked = asked.join(full, keys, "left").withColumn(share, F.coalesce(of, F.lit(0))).drop("shares")
    filed = filed.join(full, keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return asked, filed, [*keys, share]


def _meet(asked: DataFrame, filed: DataFrame, rows: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` and ``filed`` joined by cell; ``rows``: about how many both are.

    Where the session's partitions would hold more than ``TASK_ROWS`` each, there are as many
    tasks as the rows need, and a cell that ``asked`` fills with more is dealt over several.
    ``by``: further keys, of two sides that are not the same rows; then a cell that ``filed``
    fills is dealt too.
    """
    keys = ["level", "gx", "gy", *by]
    tasks = -(-rows // TASK_ROWS)
    if tasks > int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        asked, filed, keys = _dealt(asked, filed, keys, "share")
        if by:
            filed, asked, keys = _dealt(filed, asked, keys, "back")
        # the number is given, since no session knows what its files become as cells
        asked, filed = asked.repartition(tasks, *keys), filed.repartition(tasks, *keys)
    return asked.join(shuffled(filed), keys).drop("share", "back")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 40.0, pad: float = 0.0) -> DataFrame:
    """Every (point, box) with the point in the box widened by ``pad``, prefixes ``p_`` and ``r_``.

    Boxes are filed under the cells that they meet, each on the grid that fits its
    width, and points under their one cell of every grid in use, so the join is by key.
    """
    p = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    named = [F.col(c).alias(f"r_{c}") for c in boxes.columns]
    levels = _levels(boxes, cell, pad)
    if not levels:
        return p.crossJoin(boxes.select(*named).limit(0))
    filed = with_cells(boxes.withColumn("level", _level(cell, pad)), cell, pad).select("level", "gx", "gy", *named)
    at = p.withColumn("level", F.explode(F.lit(list(levels))))
    at = at.withColumns({"gx": _cell(F.col("p_x"), _width(cell)), "gy": _cell(F.col("p_y"), _width(cell))})
    rows = points.count() * len(levels) + 4 * sum(levels.values())
    near = _meet(at, filed, rows).drop("level", "gx", "gy")
    inside = lambda v, low, high: F.col(v).between(F.col(low) - pad, F.col(high) + pad)
    return near.where(inside("p_x", "r_minx", "r_maxx") & inside("p_y", "r_miny", "r_maxy"))


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float = 40.0, budget: int | None = None) -> DataFrame:
    """Every (point, ring) with the point inside, prefixes ``p_`` and ``r_``. ``budget`` refuses before the exact test."""
    pairs = points_in_boxes(points, rings, cell)
    if budget is not None:
        refuse_oversize("point and ring pairs", pairs.limit(budget + 1).count(), budget, "narrow the layers")
    return pairs.where(G.point_in_ring(F.col("p_x"), F.col("p_y"), F.col("r_ring")))


def within_radius(centres: DataFrame, others: DataFrame, radius: float, same: list[str] | None = None, cell: float | None = None) -> DataFrame:
    """Pairs (c_*, o_*) of points at most ``radius`` apart, and equal in the columns ``same``.

    Cells are as wide as the radius, so each centre asks nine. Where few points lie so near
    each other, give a ``cell`` several times as wide: most centres then ask one.
    """
    c = centres.select(*[F.col(x).alias(f"c_{x}") for x in centres.columns])
    width = radius if cell is None else cell
    if cell is None:
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        c = c.withColumn("d", around).withColumns({"gx": _cell(F.col("c_x"), width) + F.col("d.i"), "gy": _cell(F.col("c_y"), width) + F.col("d.j")})
    else:
        reach = radius * 1.001  # what rounding adds stays in
        meets = lambda v: F.explode(F.sequence(_cell(F.col(v) - reach, width), _cell(F.col(v) + reach, width)))
        c = c.withColumn("gx", meets("c_x")).withColumn("gy", meets("c_y"))
    o = others.select(*[F.col(x).alias(f"o_{x}") for x in others.columns])
    o = o.withColumns({"gx": _cell(F.col("o_x"), width), "gy": _cell(F.col("o_y"), width)})
    keys = {f"same{k}": x for k, x in enumerate(same or [])}
    c, o = c.withColumns({k: F.col(f"c_{x}") for k, x in keys.items()}), o.withColumns({k: F.col(f"o_{x}") for k, x in keys.items()})
    near = c.join(shuffled(o), ["gx", "gy", *keys]).drop("gx", "gy", "d", *keys)
    return near.withColumn("distance", F.hypot(F.col("o_x") - F.col("c_x"), F.col("o_y") - F.col("c_y"))).where(F.col("distance") <= radius)


def nearest(centres: DataFrame, others: DataFrame, first: float) -> DataFrame:
    """For each of ``centres`` (handle, x, y) the nearest of ``others`` with another handle, the least handle on a tie.

    (handle, nearest, distance, rounded to 6.) Looks within ``first``; those that found none
    there descend from cells that span everything to cells of width ``first``, and keep at
    each step the cells that may hold a nearer one than some cell surely holds. So a far
    centre meets the points of a few cells, however many lie within four times its
    distance. One without any other is left out.
    """
    o = others.select("handle", "x", "y")
    near = within_radius(centres.select("handle", "x", "y"), o, first).where("c_handle <> o_handle").select(F.col("c_handle").alias("handle"), F.col("o_handle").alias("nearest"), "distance")
    least = F.min(F.struct(F.round("distance", 6).alias("distance"), "nearest")).alias("best")
    best = checkpointed(near.groupBy("handle").agg(least).select("handle", "best.nearest", "best.distance"))
    far = checkpointed(centres.select("handle", "x", "y").join(shuffled(best.select("handle")), "handle", "left_anti"))
    if far.isEmpty() or o.isEmpty():
        return best
    cells = o.withColumns({"gx": _cell(F.col("x"), first), "gy": _cell(F.col("y"), first)})
    level = checkpointed(cells.groupBy("gx", "gy").agg(F.min("handle").alias("lo"), F.max("handle").alias("hi")))
    tower = [level]
    while len(top := level.limit(5).collect()) > 4:  # four cells at most stay
        up = level.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy"))
        level = checkpointed(up.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        tower.append(level)
    roots = [F.struct(*[F.lit(r[c]).cast(level.schema[c].dataType).alias(c) for c in ("gx", "gy", "lo", "hi")]) for r in top]
    held = far.withColumn("cell", F.explode(F.array(*roots))).select("handle", "x", "y", "cell.*")
    for k in range(len(tower) - 1, -1, -1):
        if k < len(tower) - 1:
            under = tower[k].select(F.shiftright("gx", 1).alias("px"), F.shiftright("gy", 1).alias("py"), *tower[k].columns)
            held = held.select("handle", "x", "y", F.col("gx").alias("px"), F.col("gy").alias("py")).join(shuffled(under), ["px", "py"]).drop("px", "py")
        held = checkpointed(_may_hold(held, first * 2**k))
    met = held.select(F.col("handle").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"), "gx", "gy").join(shuffled(cells), ["gx", "gy"]).where("c <> handle")
    found = met.select(F.col("c").alias("handle"), F.col("handle").alias("nearest"), F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")).alias("distance"))
    return best.unionByName(found.groupBy("handle").agg(least).select("handle", "best.nearest", "best.distance"))


def _may_hold(held: DataFrame, width: float) -> DataFrame:
    """Of each centre's cells (gx, gy; lo, hi: least and greatest handle inside) those that may hold the nearest other."""
    low, high = [F.col(c) * F.lit(width) for c in ("gx", "gy")], [(F.col(c) + 1) * F.lit(width) for c in ("gx", "gy")]
    at = [F.col("x"), F.col("y")]
    out = [F.greatest(a - p, p - b, F.lit(0.0)) for p, a, b in zip(at, low, high)]
    across = [F.greatest(p - a, b - p) for p, a, b in zip(at, low, high)]
    others = held.where("not (lo = handle and hi = handle)")  # a cell that holds more than the centre itself
    bounded = others.withColumn("surely", F.min(F.hypot(*across)).over(Window.partitionBy("handle")))
    # what rounds to the same distance stays
    return bounded.where(F.hypot(*out) <= F.col("surely") + 1e-6).drop("surely")


def rings_near(a: DataFrame, cell: float, reach: float) -> DataFrame:
    """Pairs a.handle < b.handle of rings at most ``reach`` apart, with their ``distance`` (0: touching, crossing or inside)."""
    pairs = box_pairs(a, cell, reach / 2)
    # as rows of a generator the distance is worked out once, for pairs whose boxes met
    distance = F.array(G.ring_to_ring(F.col("a_ring"), F.col("b_ring")))
    return pairs.withColumn("distance", F.explode(F.filter(distance, lambda d: d <= reach)))


def _extent(df: DataFrame, cell: float, pad: float) -> tuple[dict[int, int], list[float]]:
    """:func:`_levels`, and the box around all boxes of ``df`` (minx, miny, maxx, maxy)."""
    bounds = [F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")]
    found = df.groupBy(_level(cell, pad).alias("level")).agg(F.count(F.lit(1)).alias("n"), *bounds).where("level is not null").collect()
    around = [f(v, default=0.0) for f, v in zip((min, min, max, max), ([r[k] for r in found if r[k] is not None] for k in range(2, 6)))]
    return dict(sorted((r.level, r.n) for r in found)), around


def _boxes_meet(a: list[Column], b: list[Column], pad: float) -> Column:
    """Whether two boxes (minx, miny, maxx, maxy), each widened by ``pad``, overlap."""
    return (a[0] - pad <= b[2] + pad) & (b[0] - pad <= a[2] + pad) & (a[1] - pad <= b[3] + pad) & (b[1] - pad <= a[3] + pad)


def box_matches(a: DataFrame, b: DataFrame, cell: float, pad: float = 0.0, within: DataFrame | None = None) -> DataFrame:
    """Every pair of a row of ``a`` and one of ``b`` whose boxes, each widened by ``pad``, overlap, prefixes ``a_`` and ``b_``.

    A pair meets on the grid of its wider box, in one cell. Rows of one table never meet
    each other, however many lie in a cell. Rows of ``b`` outside the whole extent of ``a``
    are left out before they are filed, and the rest is worked out once. ``within``: boxes
    that hold those of ``a`` and cost less to read, for the extent.
    """
    corners = ("minx", "miny", "maxx", "maxy")
    boxed = lambda prefix="": [F.col(f"{prefix}{c}") for c in corners]
    named = lambda x, prefix: [F.col(c).alias(f"{prefix}_{c}") for c in x.columns]
    a_levels, a_extent = _extent(a if within is None else within, cell, pad)
    b = checkpointed(b.where(_boxes_meet(boxed(), [F.lit(v) for v in a_extent], pad)))
    b_levels = _levels(b, cell, pad)
    if not a_levels or not b_levels:
        return a.select(*named(a, "a")).crossJoin(b.select(*named(b, "b")).limit(0))

    def placed(x: DataFrame, prefix: str, levels: list[Column]) -> DataFrame:
        rows = x.withColumn("own", _level(cell, pad)).withColumn("at", F.explode(F.concat(*levels)))
        return with_cells(rows.withColumns({"level": F.col("at.level"), "wide": F.col("at.wide")}), cell, pad).select("level", "gx", "gy", "wide", *named(x, prefix))

    own = F.col("own")
    # wide: whose grid it is, b's where both boxes are of one level
    on = lambda wide, levels: F.transform(levels, lambda k: F.struct(k.alias("level"), F.lit(wide).alias("wide")))
    used = lambda levels, test: F.filter(F.lit(list(levels)), test)
    asked = placed(a, "a", [on("b", used(b_levels, lambda k: k >= own)), on("a", F.when(own > min(b_levels), F.array(own)).otherwise(F.array().cast("array<int>")))])
    filed = placed(b, "b", [on("b", F.array(own)), on("a", used(a_levels, lambda k: k > own))])
    rows = 4 * sum(n * (1 + sum(x >= k for x in b_levels)) for k, n in a_levels.items()) + 4 * sum(n * (1 + sum(x > k for x in a_levels)) for k, n in b_levels.items())
    near = _meet(asked, filed, rows, by=("wide",)).where(_boxes_meet(boxed("a_"), boxed("b_"), pad))
    # the cell of the overlap's least corner answers for the pair
    home = lambda c: F.greatest(_cell(F.col(f"a_{c}") - pad, _width(cell)), _cell(F.col(f"b_{c}") - pad, _width(cell)))
    return near.where((F.col("gx") == home("minx")) & (F.col("gy") == home("miny"))).drop("level", "gx", "gy", "wide")


def box_pairs(a: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """Pairs a.handle < b.handle whose boxes, each widened by ``pad``, overlap; each is found in one cell only.

    A box is filed on the grid that fits its width and looked up on its own and every
    wider grid in use, so boxes of any width fill few cells.
    """
    boxes = a.withColumn("own", _level(cell, pad))
    filed = with_cells(boxes.withColumn("level", F.col("own")), cell, pad).select("level", "gx", "gy", *[F.col(c).alias(f"f_{c}") for c in a.columns])
    levels = _levels(a, cell, pad)
    wider = boxes.withColumn("level", F.explode(F.filter(F.lit(list(levels) or [0]), lambda x: x >= F.col("own"))))
    asked = with_cells(wider, cell, pad).select("level", "gx", "gy", "own", *[F.col(c).alias(f"q_{c}") for c in a.columns])
    rows = 4 * sum(n * (1 + sum(x >= own for x in levels)) for own, n in levels.items())
    near = _meet(asked, filed, rows).where(
        ((F.col("own") < F.col("level")) | (F.col("f_handle") < F.col("q_handle")))
        & (F.col("f_minx") - pad <= F.col("q_maxx") + pad)
        & (F.col("q_minx") - pad <= F.col("f_maxx") + pad)
        & (F.col("f_miny") - pad <= F.col("q_maxy") + pad)
        & (F.col("q_miny") - pad <= F.col("f_maxy") + pad)
    )
    # the cell of the overlap's least corner answers for the pair
    home = lambda c: F.greatest(_cell(F.col(f"f_{c}") - pad, _width(cell)), _cell(F.col(f"q_{c}") - pad, _width(cell)))
    near = near.where((F.col("gx") == home("minx")) & (F.col("gy") == home("miny")))
    swap = F.col("q_handle") < F.col("f_handle")
    side = lambda x, y: [F.when(swap, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")) for c in a.columns]
    named = [*zip(side("q", "f"), [f"a_{c}" for c in a.columns]), *zip(side("f", "q"), [f"b_{c}" for c in a.columns])]
    return near.select(*[c.alias(n) for c, n in named])


def _clipped(shape: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex shapes (n, m, 2), of ``size`` vertices each, cut to the left of the lines from p to q."""
    m = shape.shape[1]
    at = np.arange(m)
    real = at < size[:, None]
    after = np.where(at + 1 < size[:, None], at + 1, 0)
    way = q - p
    side = way[:, None, 0] * (shape[:, :, 1] - p[:, None, 1]) - way[:, None, 1] * (shape[:, :, 0] - p[:, None, 0])
    next_side = np.take_along_axis(side, after, axis=1)
    crosses = real & (side * next_side < 0)
    part = side / np.where(crosses, side - next_side, 1.0)
    cut = shape + (np.take_along_axis(shape, after[:, :, None], axis=1) - shape) * part[:, :, None]
    both = np.stack((shape, cut), axis=2).reshape(len(shape), 2 * m, 2)
    keep = np.stack((real & (side >= 0), crosses), axis=2).reshape(len(shape), 2 * m)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : m + 1]
    return np.take_along_axis(both, order[:, :, None], axis=1), keep.sum(axis=1)


def _areas(shape: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed areas of shapes of ``size`` vertices."""
    at = np.arange(shape.shape[1])
    after = np.take_along_axis(shape, np.where(at + 1 < size[:, None], at + 1, 0)[:, :, None], axis=1)
    cross = shape[:, :, 0] * after[:, :, 1] - after[:, :, 0] * shape[:, :, 1]
    return np.where(at < size[:, None], cross, 0).sum(axis=1) / 2


def _fan(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles from the first corner of each ring, and the ring of each."""
    size = np.array([len(v) for v in x])
    start = np.cumsum(size) - size
    ring = np.repeat(np.arange(len(size)), np.maximum(size - 2, 0))
    k = np.arange(len(ring)) - np.searchsorted(ring, ring) + 1
    xy = np.column_stack((np.concatenate(x), np.concatenate(y))).astype(float) if len(x) else np.zeros((0, 2))
    return np.stack((xy[start[ring]], xy[start[ring] + k], xy[start[ring] + k + 1]), axis=1), ring


def _shared_areas(ax: list, ay: list, bx: list, by: list) -> np.ndarray:
    """Shared area of each pair of rings: the signed sum over pairs of their fans' triangles."""
    s, of_s = _fan(ax, ay)
    t, of_t = _fan(bx, by)
    n = np.bincount(of_t, minlength=len(ax))
    first = np.cumsum(n) - n
    left = np.repeat(np.arange(len(s)), n[of_s])
    right = first[of_s[left]] + np.arange(len(left)) - np.searchsorted(left, left)
    s, t, pair = s[left], t[right], of_s[left]
    shift = np.minimum(s.min(axis=1), t.min(axis=1))[:, None, :]
    s, t = s - shift, t - shift
    three = np.full(len(s), 3)
    sa, ta = _areas(s, three), _areas(t, three)
    s = np.where((sa < 0)[:, None, None], s[:, ::-1], s)
    t = np.where((ta < 0)[:, None, None], t[:, ::-1], t)
    shape, size = s, three
    for k in range(3):
        shape, size = _clipped(shape, size, t[:, k], t[:, (k + 1) % 3])
    return np.abs(np.bincount(pair, np.sign(sa) * np.sign(ta) * np.abs(_areas(shape, size)), len(ax)))


def ring_overlap_area(pairs: DataFrame) -> DataFrame:
    """Add ``overlap``: shared area of a_ring and b_ring (both convex or not), all pairs of a batch at once; null rings share none."""

    @F.pandas_udf("double")
    def overlap(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(_shared_areas(list(ax), list(ay), list(bx), list(by)), dtype="float64")

    side = lambda r, c: F.coalesce(F.col(f"{r}_ring.{c}").cast("array<double>"), F.array().cast("array<double>"))
    return pairs.withColumn("overlap", overlap(side("a", "x"), side("a", "y"), side("b", "x"), side("b", "y")))
