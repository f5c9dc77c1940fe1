"""Road and pipe networks: ends that meet within a tolerance, nodes, chains, and ends on other paths.

Paths are rows of handle, ax, ay, bx, b_y (their two ends) and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planline.functions import geometry as G
from planline.operators import spatial, windows
from planline.operators.graph import checkpointed, connected_components, linked, shuffled

#: The tolerance is this part of the median length, or of the greatest coordinate where that is more.
SNAP_FRACTION, NOISE = 1e-4, 1e-12


def snap_tolerance(paths: DataFrame) -> DataFrame:
    """One row: ``tolerance`` and whether the ``median`` length or the ``noise`` of the coordinates decided it."""
    reach = paths.agg(F.max(F.greatest(*[F.abs(c) for c in ("ax", "ay", "bx", "b_y")])).alias("reach"))
    median = windows.quantiles(paths.where("length > 0"), [], "length", {"median": 0.5}).select("median")
    both = reach.join(median, F.lit(True), "left")
    scale, noise = F.coalesce(SNAP_FRACTION * F.col("median"), F.lit(0.0)), F.coalesce(NOISE * F.col("reach"), F.lit(0.0))
    return both.select(F.greatest(scale, noise).alias("tolerance"), F.when(scale >= noise, "median").otherwise("noise").alias("decided_by"))


def ends(paths: DataFrame) -> DataFrame:
    """(handle, side, id, x, y): both ends of each path that has them; ``id`` is twice the handle, and one more for the second."""
    side = lambda k, x, y: F.struct(F.lit(k).alias("side"), F.col(x).alias("x"), F.col(y).alias("y"))
    both = paths.select("handle", F.explode(F.array(side(0, "ax", "ay"), side(1, "bx", "b_y"))).alias("e"))
    return both.select("handle", "e.side", (F.col("handle") * 2 + F.col("e.side")).alias("id"), "e.x", "e.y").where("x is not null and y is not null")


#: Tiles are this many tolerances wide, and begin at this part of their width, so that drawn lattices seldom lie on their sides.
TILE, SHIFT = 64, 0.37
#: Pairs of places that a task compares at once.
PAIRS = 1_000_000


def _near_places(x: np.ndarray, y: np.ndarray, tolerance: float, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of places at most ``tolerance`` apart, by cells as wide; each pair once."""
    wide = tolerance * 1.001  # what rounding adds stays in
    with np.errstate(invalid="ignore", over="ignore"):
        across, up = (np.floor(v / wide).astype(np.int64).view(np.uint64) for v in (x, y))
    # cells that share a key by chance only add pairs that the distance refuses
    steps = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    key = across * np.uint64(steps[0]) + up * np.uint64(steps[1])
    order = np.argsort(key, kind="stable")
    held = key[order]
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (1, -1)):
        there = held + np.uint64((i * steps[0] + j * steps[1]) % 2**64)
        low = np.arange(1, len(held) + 1) if i == j == 0 else np.searchsorted(held, there, "left")
        n = np.searchsorted(held, there, "right") - low
        asked = np.flatnonzero(n > 0)
        total = np.cumsum(n[asked])
        at = 0
        while at < len(asked):
            # rows of one place are compared whole or in parts of ``most``
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            some = asked[at:end]
            for part in range(0, int(n[some[0]]) if len(some) == 1 else 1, most):
                size = np.minimum(n[some] - part, most) if len(some) == 1 else n[some]
                a = np.repeat(some, size)
                b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[some] + part, size)
                a, b = order[a], order[b]
                with np.errstate(invalid="ignore"):
                    near = np.hypot(x[a] - x[b], y[a] - y[b]) <= tolerance
                yield a[near], b[near]
            at = end


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that hang together by pairs (a, b), for each number."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (a, b):
            np.minimum.at(after, side, low)
            np.minimum.at(after, root[side], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _linking(tolerance: float, most: int):
    """Arrow batches (id, x, y) to links (a, b): b is the first end at a's place, or the least place that a's hangs on here.

    Only places that differ are held, so many ends at a place take no room; ``most`` rows wait
    until they are merged.
    """

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            """One row a place in ``held``; the ends that go, and which stay for them."""
            ids, x, y = (np.concatenate(c) for c in zip(held, *waiting))
            # equal as bits, with one zero and one NaN
            bits = [np.where(np.isnan(v), np.nan, v + 0.0).view(np.int64) for v in (x, y)]
            order = np.lexsort((ids, *bits))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (bits[0][order][1:] != bits[0][order][:-1]) | (bits[1][order][1:] != bits[1][order][:-1])
            first = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = ids[order] != first
            keep = order[new]
            held[:] = ids[keep], x[keep], y[keep]
            waiting.clear()
            return ids[order][gone], first[gone]

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows > max(most, len(held[0])):
                yield links(*merged())
                rows = 0
        if waiting:
            yield links(*merged())
        ids, x, y = held
        if tolerance > 0 and len(ids):
            found = [np.stack(pair) for pair in _near_places(x, y, tolerance) if len(pair[0])]
            if found:
                order = np.argsort(ids)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                a, b = rank[np.concatenate(found, axis=1)]
                root = _rooted(len(ids), a, b)
                moved = np.flatnonzero(root != np.arange(len(ids)))
                yield links(ids[order][moved], ids[order][root[moved]])

    return run


def end_links(all_ends: DataFrame, tolerance: float) -> DataFrame:
    """(a, b): links that hold together the ends (id, x, y) that hang together by steps of at most ``tolerance``; an end alone has none.

    Ends are dealt by tiles, each to every tile within its reach, and go over the network
    once; what is linked in a tile comes out as one link an end. A tolerance of 0 links
    equal places alone.
    """
    rows = all_ends.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // spatial.TASK_ROWS))
    if tolerance > 0:
        wide, reach = TILE * tolerance, tolerance * 1.001  # what rounding adds stays in
        tile = lambda v: F.floor(v / wide + SHIFT).cast("long")
        meets = lambda v: F.explode(F.sequence(tile(F.col(v) - reach), tile(F.col(v) + reach)))
        rows = rows.withColumn("tx", meets("x")).withColumn("ty", meets("y"))
        place = F.xxhash64("tx", "ty")
    else:
        place = F.xxhash64("x", "y")
    # a small number goes along instead of the tile
    dealt = rows.select("id", "x", "y", F.pmod(place, F.lit(64 * tasks)).cast("int").alias("deal")).repartition(tasks, "deal")
    return dealt.select("id", "x", "y").mapInArrow(_linking(tolerance, spatial.TASK_ROWS), "a long, b long")


def clustered_ends(paths: DataFrame, tolerance: float) -> DataFrame:
    """:func:`ends` with ``node``: the least id of the ends that hang together by steps of at most ``tolerance``.

    A tolerance of 0 joins equal places alone.
    """
    all_ends = ends(paths)
    nodes = linked(end_links(all_ends, tolerance)).withColumnRenamed("node", "id")
    return all_ends.join(shuffled(nodes), "id", "left").select(*all_ends.columns, F.coalesce("component", "id").alias("node"))


def path_chains(paths: DataFrame, tolerance: float) -> DataFrame:
    """(handle, chain) of the paths with an end: the least handle of those that hang together by ends within ``tolerance``.

    :func:`chains` of :func:`clustered_ends` without the nodes: links of ends are links of paths.
    """
    of = lambda c: F.shiftright(c, 1).alias(c)
    found = linked(end_links(ends(paths), tolerance).select(of("a"), of("b"))).withColumnRenamed("node", "handle")
    handles = paths.where("(ax is not null and ay is not null) or (bx is not null and b_y is not null)").select("handle").distinct()
    return handles.join(shuffled(found), "handle", "left").select("handle", F.coalesce("component", "handle").alias("chain"))


def node_degrees(clustered: DataFrame) -> DataFrame:
    """(node, degree, x, y): how many ends meet at each node, and where its first end is."""
    first = F.min_by(F.struct("x", "y"), "id").alias("at")
    return clustered.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), first).select("node", "degree", "at.x", "at.y")


def chains(clustered: DataFrame) -> DataFrame:
    """(handle, chain): the least node of the paths that hang together at their nodes."""
    two = clustered.groupBy("handle").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    nodes = connected_components(clustered.select("node").distinct(), two.where("a < b").select("a", "b"))
    return two.join(shuffled(nodes), F.col("a") == F.col("node")).select("handle", F.col("component").alias("chain"))


def attachments(nodes: DataFrame, paths: DataFrame, tolerance: float, cell: float) -> DataFrame:
    """(node, handle, distance): nodes that lie on the inside of a path within ``tolerance``, not at its ends."""
    boxes = paths.where("ax is not null and bx is not null").select(
        "handle", "ax", "ay", "bx", "b_y",
        F.least("ax", "bx").alias("minx"), F.least("ay", "b_y").alias("miny"), F.greatest("ax", "bx").alias("maxx"), F.greatest("ay", "b_y").alias("maxy"),
    )
    near = spatial.points_in_boxes(nodes.select("node", "x", "y"), boxes, cell, tolerance)
    point = lambda x, y: F.struct(F.col(f"r_{x}").alias("x"), F.col(f"r_{y}").alias("y"))
    a, b = point("ax", "ay"), point("bx", "b_y")
    away = lambda e: F.hypot(F.col("p_x") - e["x"], F.col("p_y") - e["y"])
    near = near.withColumn("distance", G.point_segment_distance(F.col("p_x"), F.col("p_y"), a, b))
    inside = (F.col("distance") <= tolerance) & (away(a) > tolerance) & (away(b) > tolerance)
    return near.where(inside).select(F.col("p_node").alias("node"), F.col("r_handle").alias("handle"), "distance")


#: Ends that meet in a node from which it is a junction.
JUNCTION = 3


def junction_spacings(clustered: DataFrame, paths: DataFrame) -> DataFrame:
    """(handle, length, kind) of each path: spacing where both its ends are at junctions, else why it says nothing of them.

    one_end (an end has no node), not_between (a node of fewer than JUNCTION ends),
    unmeasured (both are junctions, no length).
    """
    degrees = clustered.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ends_of = clustered.join(shuffled(degrees), "node").groupBy("handle").agg(F.count(F.lit(1)).alias("ends"), F.min("degree").alias("least"))
    rows = paths.select("handle", "length").join(shuffled(ends_of), "handle", "left")
    kind = (
        F.when(F.coalesce("ends", F.lit(0)) < 2, "one_end").when(F.col("least") < JUNCTION, "not_between").when(F.col("length").isNull(), "unmeasured").otherwise("spacing")
    )
    return rows.select("handle", "length", kind.alias("kind"))


def road_hierarchy(paths: DataFrame, tolerance: float) -> DataFrame:
    """One row on a network: spacings between junctions (count, least, quartiles, most, mean, total), paths that say none, dead ends."""
    clustered = clustered_ends(paths, tolerance)
    rows = checkpointed(junction_spacings(clustered, paths))
    spacing = rows.where("kind = 'spacing'")
    sums = spacing.agg(
        F.count(F.lit(1)).alias("spacings"), F.min("length").alias("least"), F.max("length").alias("most"), F.avg("length").alias("mean"), F.sum("length").alias("total")
    )
    quartiles = windows.quantiles(spacing, [], "length", {"p25": 0.25, "median": 0.5, "p75": 0.75}).drop("n")
    excluded = rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("one_end", "not_between", "unmeasured")])
    dead = node_degrees(clustered).agg(F.count_if(F.col("degree") == 1).alias("dead_ends"))
    # one row each
    return sums.join(quartiles, F.lit(True), "left").crossJoin(excluded).crossJoin(dead)


def corridor_widths(rings: DataFrame, group: list[str]) -> DataFrame:
    """Widths of a layer of strips by rings' area and perimeter: (group, rings, least, median, mean, most, median_length).

    Of a long strip area is width times length and the perimeter twice their sum, so twice
    the area over the perimeter is its mean width. ``median_length`` (area over width) tells
    where that does not hold: near the width, the shape is no corridor. Rings without an
    area or a perimeter are not measured.
    """
    width = 2 * F.col("area") / F.col("perimeter")
    rows = checkpointed(rings.where("area > 0 and perimeter > 0").select(*group, width.alias("width"), (F.col("area") / width).alias("length")))
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rings"), F.min("width").alias("least"), F.avg("width").alias("mean"), F.max("width").alias("most"))
    at = windows.quantiles(rows, group, "width", {"median": 0.5}).drop("n").join(windows.quantiles(rows, group, "length", {"median_length": 0.5}).drop("n"), group)
    return sums.join(at, group)
