import math
import random

import pytest
from pyspark.sql import functions as F

from planline.functions import geometry as G
from planline.operators import spatial as S

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def one(spark, points, **columns):
    df = spark.createDataFrame([(ring(points),)], f"ring {RING}")
    return df.select(*[c.alias(k) for k, c in columns.items()]).first()


def test_area_centroid_at_projected_magnitude(spark):
    e, n = 691942.0, 2750756.0
    square = [(e, n), (e + 10, n), (e + 10, n + 20), (e, n + 20)]
    r = one(spark, square, area=G.signed_area(F.col("ring")), c=G.centroid(F.col("ring")), p=G.perimeter(F.col("ring")))
    assert r.area == 200.0 and (r.c.x, r.c.y) == (e + 5, n + 10) and r.p == 60.0
    r = one(spark, square[::-1], area=G.signed_area(F.col("ring")))
    assert r.area == -200.0


def test_flat_ring_has_no_centroid(spark):
    r = one(spark, [(0, 0), (1, 1), (2, 2)], c=G.centroid(F.col("ring")))
    assert r.c is None


def test_dedupe_drops_repeats_and_closer(spark):
    r = one(spark, [(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)], d=G.dedupe(F.col("ring")))
    assert [(p.x, p.y) for p in r.d] == [(0, 0), (1, 0), (1, 1)]


@pytest.mark.parametrize("point,place", [((0.5, 0.5), "inside"), ((2.5, 2.0), "outside"), ((0, 1), "boundary"), ((3, 3), "boundary"), ((9, 9), "outside")])
def test_place_in_concave_ring(spark, point, place):
    c = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 2.5), (3, 2.5), (3, 3), (0, 3)]
    r = one(spark, c, p=G.place_in_ring(F.lit(float(point[0])), F.lit(float(point[1])), F.col("ring")))
    assert r.p == place


def test_shape_key_is_invariant(spark):
    base = [(0, 0), (5, 0), (6, 2), (1, 4)]
    turn = lambda p, a: (p[0] * math.cos(a) - p[1] * math.sin(a) + 70, p[0] * math.sin(a) + p[1] * math.cos(a) - 3)
    other = [turn(p, 0.7) for p in base[2:] + base[:2]]
    key = lambda pts: one(spark, pts, k=G.shape_key(F.col("ring"))).k
    assert key(base) == key(other) != key([(x * 1.1, y) for x, y in base])


def test_utm_round_values(spark):
    r = spark.range(1).select(G.utm_to_lat_lon(F.lit(500000.0), F.lit(0.0), F.lit(31), F.lit(False)).alias("a")).first().a
    assert abs(r.lat) < 1e-9 and abs(r.lon - 3) < 1e-9


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(20260824)
    rings, points = [], []
    for k in range(60):
        x, y, w, h, a = rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(1, 300 if k % 9 == 0 else 60), rnd.uniform(1, 60), rnd.uniform(0, 3)
        pts = [(x + u * math.cos(a) - v * math.sin(a), y + u * math.sin(a) + v * math.cos(a)) for u, v in ((0, 0), (w, 0), (w, h), (0, h))]
        xs, ys = zip(*pts)
        rings.append((k, min(xs), min(ys), max(xs), max(ys), ring(pts)))
    for k in range(300):
        points.append((k, rnd.uniform(-50, 1000), rnd.uniform(-50, 1000)))
    r = spark.createDataFrame(rings, f"handle int, minx double, miny double, maxx double, maxy double, ring {RING}")
    p = spark.createDataFrame(points, "handle int, x double, y double")
    found = {(x.p_handle, x.r_handle) for x in S.points_in_rings(p, r, 20.0).collect()}

    def inside(px, py, pts):
        odd = False
        for a, b in zip(pts, pts[1:] + pts[:1]):
            if (a["y"] > py) != (b["y"] > py) and px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
        return odd

    assert found == {(k, q[0]) for k, x, y in points for q in rings if inside(x, y, q[5])}


def test_overlap_area(spark):
    rows = [
        (ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(2, 2), (6, 2), (6, 6), (2, 6)]), 4.0),
        (ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (1, 2), (2, 2), (2, 1)]), 1.0),
        (ring([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]), ring([(2, 2), (3, 2), (3, 3), (2, 3)]), 0.0),
        (ring([(0, 0), (1, 0), (1, 1), (0, 1)]), ring([(5, 5), (6, 5), (6, 6)]), 0.0),
    ]
    df = spark.createDataFrame(rows, f"a_ring {RING}, b_ring {RING}, want double")
    for r in S.ring_overlap_area(df).collect():
        assert r.overlap == pytest.approx(r.want, abs=1e-9)
