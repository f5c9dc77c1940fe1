"""Frames, causes, ground by depth, dimensions, copies and hexagonal cells against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planline.functions import frames
from planline.functions import geometry as G
from planline.functions import hexagons as X
from planline.operators import copies as C
from planline.operators import coverage as V
from planline.operators import truth as T

STATED = "handle long, points array<struct<x:double,y:double,z:double,bulge:double>>, closed boolean, nx double, ny double, nz double, elevation double"
RING = "array<struct<x:double,y:double>>"


def stated(spark, rows):
    return spark.createDataFrame([(h, None if p is None else [dict(zip("x y z bulge".split(), v)) for v in p], *more) for h, p, *more in rows], STATED)


def block(f, *first):
    return f(*first, *[F.col(c) for c in ("points", "closed", "nx", "ny", "nz", "elevation")])


def by_axis_rule(p, n, elevation):
    """A point out of its extrusion's frame, with vectors."""
    n = np.array(n, float) / np.linalg.norm(n)
    ax = np.cross([0, 1, 0] if abs(n[0]) < 1 / 64 and abs(n[1]) < 1 / 64 else [0, 0, 1], n)
    ax /= np.linalg.norm(ax)
    return (p[0] * ax + p[1] * np.cross(n, ax) + elevation * n)[:2]


def test_points_leave_their_extrusions_frame(spark):
    draw = random.Random(4)
    normals = [(0, 0, -1), (0, 0, 1), (1 / 65, 0, 1), (1 / 63, 0, 1), (0.6, 0, 0.8), (0, -3, 0), (1e-12, 0, 1)] + [tuple(draw.uniform(-1, 1) for _ in range(3)) for _ in range(20)]
    rows = [(k, [(draw.uniform(-9, 9), draw.uniform(-9, 9), 0.0, 0.0) for _ in range(3)], False, *map(float, n), 2.5) for k, n in enumerate(normals)]
    got = {r.handle: r.p for r in stated(spark, rows).select("handle", block(frames.path_block).points.alias("p")).collect()}
    for h, points, _, *n, e in rows:
        plain = abs(n[0]) < 1e-9 and abs(n[1]) < 1e-9 and abs(n[2] - 1) < 1e-9
        want = [p[:2] if plain else by_axis_rule(p, n, e) for p in points]
        assert np.allclose([(p.x, p.y) for p in got[h]], want, atol=1e-9)


SQUARE = [(0.0, 0.0, 0.0, 0.0), (4.0, 0.0, 0.0, 0.0), (4.0, 3.0, 0.0, 0.0), (0.0, 3.0, 0.0, 0.0)]
CASES = [
    ("complete", SQUARE, True), ("open", SQUARE, False), ("open", SQUARE, None), ("unreadable", None, True), ("unreadable", [], True), ("degenerate", SQUARE[:2] + SQUARE[:1], True),
    ("degenerate", [SQUARE[0], (2.0, 0.0, 0.0, 0.0), SQUARE[1]], True), ("degenerate", [SQUARE[0], SQUARE[2], SQUARE[1], SQUARE[3]], True), ("unreadable", [*SQUARE[:3], (1e20, 0.0, 0.0, 0.0)], True),
    ("unreadable", [*SQUARE[:3], (float("nan"), 0.0, 0.0, 0.0)], True), ("non_planar", [*SQUARE[:3], (0.0, 3.0, 1.0, 0.0)], False), ("oversize", [(math.cos(k / 1e3), math.sin(k / 1e3), 0.0, 0.0) for k in range(4001)], True),
]


@pytest.mark.parametrize("at", [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.6, 0.0, 0.8)])
def test_each_cause_is_named(spark, at):
    rows = [(k, p, c, *at, 0.0) for k, (_, p, c) in enumerate(CASES)]
    got = {r.handle: r.s for r in stated(spark, rows).select("handle", block(frames.ring_block).alias("s")).collect()}
    for k, (want, _, _) in enumerate(CASES):
        assert got[k].status == want and (got[k].ring is not None) == (want == "complete")


def test_mirrored_arcs_stay_on_their_side(spark):
    half = [(0.0, 0.0, 0.0, 0.0), (2.0, 0.0, 0.0, 1.0), (2.0, 2.0, 0.0, 0.0), (0.0, 2.0, 0.0, 0.0)]
    df = stated(spark, [(1, half, True, 0.0, 0.0, 1.0, 0.0), (2, half, True, 0.0, 0.0, -1.0, 0.0)])
    r = {x.handle: x for x in df.select("handle", block(frames.ring_block).ring.alias("ring")).select("*", G.signed_area(F.col("ring")).alias("a")).collect()}
    assert abs(r[1].a - (4 + math.pi / 2)) < 0.03 and abs(r[1].a + r[2].a) < 1e-9
    assert abs(max(p.x for p in r[1].ring) - 3) < 0.02 and abs(min(p.x for p in r[2].ring) + 3) < 0.02


def test_ends(spark):
    df = stated(spark, [(1, SQUARE, False, None, None, None, None), (2, SQUARE, True, 0.0, 0.0, 1.0, 0.0), (3, SQUARE[:1], False, 0.0, 0.0, 1.0, 0.0), (4, None, False, 0.0, 0.0, 1.0, 0.0)])
    got = {r.handle: r.e for r in df.select("handle", block(frames.ends_block, F.lit("POLYLINE")).alias("e")).collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["open_path", "closed_ring", "not_derived", "not_derived"] and (got[1].b.x, got[1].b.y) == (0.0, 3.0)
    assert df.select(block(frames.ends_block, F.lit("SPLINE")).status).distinct().collect()[0][0] == "not_derived"
    full, part = spark.range(1).select(frames.arc_path(*[F.lit(v) for v in (0.0, 0.0, 2.0, 0.0, 360.0)]).alias("a"), frames.arc_path(*[F.lit(v) for v in (0.0, 0.0, 2.0, 90.0, 180.0)]).alias("b")).first()
    assert full is None and abs(part[0].y - 2) < 1e-9 and abs(part[-1].x + 2) < 1e-9


def rings(spark, shapes):
    return spark.createDataFrame([(k, s, [dict(x=float(x), y=float(y)) for x, y in p]) for k, (s, p) in enumerate(shapes)], f"ring long, side int, points {RING}")


def inside(p, x, y):
    odd = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(p, [*p[1:], p[0]]):
        odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / ((by - ay) or 1) + ax)
    return odd


@pytest.mark.parametrize("edges_of_tile, size", [(48, 7.0), (6, 7.0), (48, 1000.0), (10, 90.0)])
def test_ground_by_depth_is_that_of_a_fine_grid(spark, monkeypatch, edges_of_tile, size):
    monkeypatch.setattr(V, "EDGES_OF_TILE", edges_of_tile)
    draw = random.Random(8)
    shapes = []
    for _ in range(14):
        x, y, n = draw.uniform(0, 30), draw.uniform(-10, 20), draw.choice([3, 4, 7])
        shapes.append((draw.randrange(2), [(x + draw.uniform(2, 9) * math.cos(k * 2 * math.pi / n), y + draw.uniform(2, 9) * math.sin(k * 2 * math.pi / n)) for k in range(n)]))
    shapes += [(0, [(0, 0), (8, 8), (8, 0), (0, 8)]), (1, [(5, 5), (15, 5), (15, 15), (5, 15)]), (1, [(5, 5), (15, 5), (15, 15), (5, 15)])]
    got = {(r.depth0, r.depth1): r.area for r in V.covered_slabs(rings(spark, shapes), size).groupBy("depth0", "depth1").agg(F.sum("area").alias("area")).collect()}
    h = 0.04
    x, y = np.meshgrid(np.arange(-12, 42, h) + h / 2, np.arange(-22, 32, h) + h / 2)
    depth = [sum(inside(p, x, y).astype(int) for s, p in shapes if s == side) for side in (0, 1)]
    for key in {(int(a), int(b)) for a, b in zip(depth[0].ravel(), depth[1].ravel())} - {(0, 0)}:
        assert abs(got.get(key, 0.0) - ((depth[0] == key[0]) & (depth[1] == key[1])).sum() * h * h) < 1.5, key


def test_three_equal_rings_leave_no_gap_and_no_boundary_gives_none(spark):
    box = [(0, 0), (10, 0), (10, 10), (0, 10)]
    claims = rings(spark, [(0, box)] * 3)
    assert tuple(V.gap_block(claims, rings(spark, [(1, box)]), 4.0).first()) == (100.0, 100.0, 100.0, 0.0, 0.0)
    assert tuple(V.gap_block(claims, rings(spark, [(1, box)]).limit(0), 4.0).first()) == (0.0, 0.0, 0.0, 100.0, None)
    many = V.gap_block(rings(spark, [(0, box)] * 200), rings(spark, [(1, [(5, 0), (20, 0), (20, 10), (5, 10)])]), 4.0).first()
    assert np.allclose(tuple(many), (150, 50, 50, 50, 100))


def segment(x, y, p, q):
    d = np.subtract(q, p)
    t = min(1, max(0, np.dot(np.subtract((x, y), p), d) / (np.dot(d, d) or 1)))
    return math.hypot(*(np.subtract((x, y), p) - t * d))


def brute_truth(label, shapes):
    handle, text, x, y, radius = label
    found = []
    for h, points, edges, length, box in shapes:
        if points and edges:
            offers = {}
            for k in range(len(points)):
                away = segment(x, y, points[k], points[(k + 1) % len(points)])
                if radius is not None and away <= radius:
                    key = round(edges[k], 9)
                    offers[key] = min(offers.get(key, (math.inf, 0)), (away, edges[k]))
            found += [(d, h, m) for d, m in offers.values()]
        else:
            away = min(segment(x, y, p, q) for p, q in zip(points, points[1:] + points[:1])) if points else math.hypot(max(box[0] - x, 0, x - box[2]), max(box[1] - y, 0, y - box[3]))
            if radius is not None and away <= radius and length is not None:
                found.append((away, h, length))
    found.sort()
    if not found:
        return handle, "unassociated", None
    tolerance = max(0.005, 1e-6 * found[0][2])
    spread = max(m for _, _, m in found) - min(m for _, _, m in found)
    if len(found) > 1 and spread > tolerance:
        return handle, "ambiguous", found[0][1]
    return handle, "agrees" if abs(found[0][2] - float(text)) <= tolerance else "differs", found[0][1]


def test_dimensions_same_as_every_pair(spark):
    draw = random.Random(21)
    shapes = []
    for h in range(60):
        x, y, w, k = draw.uniform(0, 60), draw.uniform(0, 60), draw.choice([4.0, 6.0]), draw.choice([4.0, 5.0])
        points = [(x, y), (x + w, y), (x + w, y + k), (x, y + k)]
        kind = h % 4
        shapes.append((h, points if kind < 3 else None, [w, k, w, k] if kind < 2 else None, None if h % 8 == 7 else 2 * (w + k) if kind == 2 else w, (x, y, x + w, y + (k if kind < 3 else 0))))
    shapes.append((900, [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)], [1000.0] * 4, None, (-500, -500, 500, 500)))
    labels = [(k, f"{draw.choice([4, 5, 6])}.00", draw.uniform(0, 66), draw.uniform(0, 66), draw.choice([0.5, 1.5, 30.0, None])) for k in range(200)]
    ldf = spark.createDataFrame(labels, "handle long, text string, x double, y double, radius double")
    sdf = spark.createDataFrame([(h, None if p is None else [dict(x=a, y=b) for a, b in p], e, n, *map(float, b)) for h, p, e, n, b in shapes], f"handle long, points {RING}, edges array<double>, length double, minx double, miny double, maxx double, maxy double")
    rows = T.label_truth(ldf, sdf, 8.0, "m").collect()
    assert {(r.handle, r.status, r.nearest) for r in rows} == {brute_truth(t, shapes) for t in labels}
    assert len({r.status for r in rows}) == 4 and max(r.enclosing for r in rows) >= 1


def test_printed_numbers(spark):
    texts = {"25.00": (25.0, 2, None, None, None), " 1,250.5 m ": (1250.5, 1, "m", None, None), "12 ± 0.5": (12.0, 0, None, 0.5, None), "12 +/- 2 MM": (12.0, 0, "mm", 2.0, None), "12 x 25": (None, None, None, None, "size"),
             "12.5 sqm": (None, None, "sqm", None, "area"), "45°": (None, None, "°", None, "angle"), "": (None, None, None, None, "empty"), None: (None, None, None, None, "empty"), "wall": (None, None, None, None, "no number"), "-3.5": (-3.5, 1, None, None, None)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.printed_number(F.col("t")).alias("p"))
    assert {r.t: tuple(r.p) for r in df.collect()} == texts


def test_bodies_behind_one_another_and_the_live_copy(spark):
    """A pinwheel of bodies needs cuts by both axes in turn; three of them are the same but for a shift."""
    body = [(0, 0, 5, 3), (6, 0, 9, 9), (0, 5, 4, 8)]
    places = {"a": (0, 0), "b": (40, 0), "c": (40, 40), "d": (62, 40), "bar": (36, 70)}
    rows, members = [], {}
    for name, (ox, oy) in places.items():
        for x0, y0, x1, y1 in [(0, 0, 10, 2), (14, 0, 24, 2), (28, 0, 38, 2)] if name == "bar" else body[:2] + [(0, 5, 4, 8.5)] if name == "d" else body:
            rows.append((len(rows), "R", float(ox + x0), float(oy + y0), float(ox + x1), float(oy + y1)))
            members.setdefault(name, set()).add(len(rows) - 1)
    rows.append((99, "R", None, 0.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "handle long, layer string, minx double, miny double, maxx double, maxy double").repartition(3)
    placed = C.bodies(df, "layer")
    got = {}
    for r in placed.collect():
        got.setdefault(r.body, set()).add(r.handle)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, members.values()))
    others = spark.createDataFrame([(41.0, 1.0), (42.0, 2.0), (1.0, 1.0), (500.0, 500.0)], "x double, y double")
    chosen = {r.body: r for r in C.chosen_copies(C.body_summaries(placed, "layer"), others, "layer", 20.0).collect()}
    first = {n: min(m) for n, m in members.items()}
    assert [chosen[first[n]].copies for n in ("a", "b", "c", "d", "bar")] == [3, 3, 3, 1, 1]
    assert [chosen[first[n]].live for n in ("a", "b", "c", "d", "bar")] == [False, True, False, False, False]
    assert {chosen[first[n]].first_copy for n in ("a", "b", "c")} == {first["a"]}


def test_points_lie_in_the_nearest_cell_and_parents_hold_seven(spark):
    draw = random.Random(6)
    points = [(draw.uniform(-50, 50), draw.uniform(-50, 50)) for _ in range(400)]
    df = spark.createDataFrame(points, "x double, y double").select("x", "y", X.cell_of(F.col("x"), F.col("y"), 2.5).alias("c"))
    for r in df.collect():
        cx, cy = lambda q, s: 2.5 * math.sqrt(3) * (q + s / 2), lambda s: 3.75 * s
        own = math.hypot(r.x - cx(r.c.q, r.c.r), r.y - cy(r.c.r))
        assert all(own <= math.hypot(r.x - cx(r.c.q + a, r.c.r + b), r.y - cy(r.c.r + b)) + 1e-9 for a, b in X.NEIGHBOURS)
    cells = spark.range(-20, 21).crossJoin(spark.range(-20, 21).withColumnRenamed("id", "r")).select(F.struct(F.col("id").alias("q"), "r").alias("c"))
    up = cells.select("c", X.parent(F.col("c")).alias("p")).select("c", "p", X.distance(F.col("c"), X.parent_centre(F.col("p"))).alias("d"))
    assert up.agg(F.max("d")).first()[0] == 1
    assert set(r["count"] for r in up.where("abs(p.q) <= 3 and abs(p.r) <= 3").groupBy("p").count().collect()) == {7}


def test_ring_and_path_cells_same_as_every_cell(spark):
    draw = random.Random(7)
    shapes = [[(draw.uniform(0, 40), draw.uniform(-20, 20)) for _ in range(draw.randrange(3, 8))] for _ in range(30)] + [[(1.0, 1.0), (1.1, 1.0), (1.0, 1.1)], [(0.0, 0.0), (1.0, 1.0)]]
    df = spark.createDataFrame([(k, [dict(x=x, y=y) for x, y in p]) for k, p in enumerate(shapes)], f"k long, points {RING}")
    rows = df.select("k", X.ring_cells(F.col("points"), 1.5).alias("cells"), X.path_cells(F.col("points"), 1.5).alias("walk")).collect()
    q, r = np.meshgrid(np.arange(-40, 60), np.arange(-20, 20))
    x, y = 1.5 * math.sqrt(3) * (q + r / 2), 2.25 * r
    for row in rows:
        p = shapes[row.k]
        want = set(zip(q[inside(p, x, y)].tolist(), r[inside(p, x, y)].tolist()))
        if len(p) < 3:
            assert row.cells is None
        elif want:
            assert {(c.q, c.r) for c in row.cells} == want and len(row.cells) == len(want)
        else:
            assert len(row.cells) == 1
        steps = [(b.q - a.q, b.r - a.r) for a, b in zip(row.walk, row.walk[1:])]
        assert all(s in X.NEIGHBOURS for s in steps)
        at = spark.createDataFrame([p[0], p[-1]], "x double, y double").select(X.cell_of(F.col("x"), F.col("y"), 1.5).alias("c")).collect() if row.k < 3 else None
        assert at is None or (at[0].c, at[1].c) == (row.walk[0], row.walk[-1])


def test_outline_and_disc(spark):
    c = F.struct(F.lit(3).cast("long").alias("q"), F.lit(-2).cast("long").alias("r"))
    o, d, m = spark.range(1).select(X.outline(c, 2.0).alias("o"), X.disc(c, 3).alias("d"), X.centre(c, 2.0).alias("m")).first()
    assert all(abs(math.hypot(p.x - m.x, p.y - m.y) - 2.0) < 1e-9 for p in o) and len(o) == 6
    assert len(d) == 37 and [sum(x.steps == k for x in d) for k in range(4)] == [1, 6, 12, 18]
