"""Networks, copies, nearest neighbours, quantiles, islands and joins of boxes against plain versions."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planline.adapter import parcels
from planline.operators import graph
from planline.operators import network as N
from planline.operators import spatial as S
from planline.operators import windows as W
from planline.plans.queries_joins import single_linkage

SF = "/root/testdata/sf0.001"


def components(n, edges):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_ends_within_a_tolerance(spark):
    rnd = random.Random(7)
    paths = [(k, rnd.randrange(12) + rnd.uniform(-0.01, 0.01), rnd.randrange(3) * 1.0, rnd.randrange(12) + rnd.uniform(-0.01, 0.01), rnd.randrange(3) * 1.0, 1.0) for k in range(60)]
    paths.append((60, 5.0, 1.5, None, None, None))
    df = spark.createDataFrame(paths, "handle long, ax double, ay double, bx double, b_y double, length double")
    points = [(2 * h + s, *p) for h, ax, ay, bx, b_y, _ in paths for s, p in ((0, (ax, ay)), (1, (bx, b_y))) if p[0] is not None]
    near = [(i, j) for i in range(len(points)) for j in range(i) if math.dist(points[i][1:], points[j][1:]) <= 0.012]
    root = components(len(points), near)
    want = {points[k][0]: points[root[k]][0] for k in range(len(points))}
    clustered = N.clustered_ends(df, 0.012)
    rows = clustered.collect()
    assert {r.id: r.node for r in rows} == want
    together = defaultdict(set)
    for r in rows:
        together[r.node].add(r.handle)
    edges = [(a, b) for group in together.values() for a in group for b in group]
    chain = components(61, edges)
    got = {r.handle: r.chain for r in N.chains(clustered).collect()}
    assert len({(got[h], chain[h]) for h in got}) == len(set(got.values())) == len({chain[h] for h in got})
    exact = {r.id: r.node for r in N.clustered_ends(df, 0.0).collect()}
    assert len(set(exact.values())) == len({p[1:] for p in points})


def test_single_linkage(spark):
    rows = [(r.cx, r.cy, r.handle) for r in parcels(spark, SF).orderBy("handle").collect()]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if math.dist(rows[i][:2], rows[j][:2]) <= 30])
    sizes = defaultdict(int)
    for k in root:
        sizes[k] += 1
    assert {r.component: r.members for r in single_linkage(spark, SF).collect()} == {rows[k][2]: n for k, n in sizes.items() if n > 1}


def test_nearest_at_any_distance(spark):
    rnd = random.Random(3)
    points = [(k, rnd.choice([rnd.uniform(0, 1), rnd.uniform(0, 10_000)]), rnd.uniform(0, 1)) for k in range(40)]
    df = spark.createDataFrame(points, "handle long, x double, y double")
    got = {r.handle: (r.distance, r.nearest) for r in S.nearest(df, df, 0.1).collect()}
    want = {h: min((round(math.hypot(x - a, y - b), 6), o) for o, a, b in points if o != h) for h, x, y in points}
    assert got == {h: (pytest.approx(d), o) for h, (d, o) in want.items()}
    assert S.nearest(df.limit(1), df.limit(1), 0.1).count() == 0


def test_nearest_to_far_clusters(spark):
    rnd = random.Random(5)
    cluster = [(k, -3000 + rnd.random() / 10, 40 + rnd.random() / 10) for k in range(300)]
    lattice = [(1000 + k, 500.0 * (k % 4), -500.0 * (k // 4)) for k in range(16)]  # ties on every side
    points = cluster + lattice + [(2000, 9000.0, 9000.0), (2001, 9000.0, 9000.0)]
    df = spark.createDataFrame(points, "handle long, x double, y double")
    got = {r.handle: (r.distance, r.nearest) for r in S.nearest(df.where("handle >= 1000"), df, 0.02).collect()}
    want = {h: min((round(math.hypot(x - a, y - b), 6), o) for o, a, b in points if o != h) for h, x, y in points if h >= 1000}
    assert got == {h: (pytest.approx(d), o) for h, (d, o) in want.items()}
    # a handle of the other table that stands elsewhere is not the centre's neighbour
    alone = spark.createDataFrame([(7, 0.0, 0.0)], df.schema)
    few = spark.createDataFrame([(7, 50.0, 0.0), (8, 60.0, 0.0)], df.schema)
    assert [tuple(r) for r in S.nearest(alone, few, 1.0).collect()] == [(7, 8, 60.0)]


def test_boxes_of_any_width(spark):
    rnd = random.Random(5)
    boxes = []
    for k in range(120):
        w, h = (rnd.choice([0.0, 1, 30, 5000, 100_000]) for _ in range(2))
        x, y = rnd.uniform(-5e4, 5e4), rnd.uniform(-5e4, 5e4)
        boxes.append((k, x, y, x + w, y + h))
    df = spark.createDataFrame(boxes, "handle long, minx double, miny double, maxx double, maxy double")
    apart = lambda a, b, pad: a[1] - pad > b[3] + pad or b[1] - pad > a[3] + pad or a[2] - pad > b[4] + pad or b[2] - pad > a[4] + pad
    for pad in (0.0, 700.0):
        want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and not apart(a, b, pad))
        assert sorted((r.a_handle, r.b_handle) for r in S.box_pairs(df, 10.0, pad).collect()) == want
    points = [(k, rnd.uniform(-5e4, 5e4), rnd.uniform(-5e4, 5e4)) for k in range(100)]
    p = spark.createDataFrame(points, "handle long, x double, y double")
    want = sorted((h, b[0]) for h, x, y in points for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4])
    assert sorted((r.p_handle, r.r_handle) for r in S.points_in_boxes(p, df, 10.0).collect()) == want


def test_quantiles_and_ranks(spark):
    rnd = random.Random(9)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(5)), None])) for g in ("a", "b", None) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    held = defaultdict(list)
    for g, v in rows:
        if v is not None:
            held[g].append(v)
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999}
    got = {r.g: r for r in W.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(held)
    for g, v in held.items():
        assert [got[g][k] for k in shares] == pytest.approx([float(np.quantile(v, s)) for s in shares.values()]) and got[g].n == len(v)
    for r in W.nearest_rank(df, ["g"], "v", shares).collect():
        v = sorted(held[r.g])
        assert [r[k] for k in shares] == [v[max(1, math.ceil(round(s * len(v), 9))) - 1] for s in shares.values()]
    assert W.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


@pytest.mark.parametrize("ranges", [1, 7, 1024])
def test_islands_over_ranges(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(k, g, low := rnd.uniform(0, 1000), low + rnd.choice([0.1, 3, 90])) for k in range(400) for g in [rnd.choice(["a", None])]]
    df = spark.createDataFrame(rows, "handle long, g string, low double, high double")
    want = {}
    for g in ("a", None):
        number, seen = 0, -math.inf
        for k, _, low, high in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[3], r[0])):
            number += low - seen > 2
            seen = max(seen, high)
            want[k] = number
    assert {r.handle: r.island for r in W.islands(df, ["g"], "low", "high", ["handle"], 2.0, ranges).collect()} == want


def test_overlap_of_any_rings(spark):
    """Concave rings against counting points of a fine lattice."""
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    square = [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)]
    ring = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [(ring(ell), ring(square)), (ring(ell[::-1]), ring(square)), (ring(ell), ring([(5, 5), (6, 5), (6, 6)])), (ring(ell), None)]
    df = spark.createDataFrame(rows, "a_ring array<struct<x:double,y:double>>, b_ring array<struct<x:double,y:double>>")
    got = [r.overlap for r in S.ring_overlap_area(df).collect()]
    assert got == pytest.approx([2.25, 2.25, 0.0, 0.0])


def test_near_places_in_parts():
    rnd = random.Random(11)
    points = [(rnd.choice([0.0, 5e6, -3.0]) + rnd.uniform(-0.05, 0.05), rnd.uniform(-0.05, 0.05)) for _ in range(300)]
    x, y = (np.array(c) for c in zip(*points))
    want = {(i, j) for i in range(300) for j in range(i) if math.hypot(x[i] - x[j], y[i] - y[j]) <= 0.02}
    for most in (1, 7, 10**6):
        got = [tuple(sorted((int(a), int(b)), reverse=True)) for part in N._near_places(x, y, 0.02, most) for a, b in zip(*part)]
        assert set(got) == want and len(got) == len(want)
    root = components(300, want)
    assert N._rooted(300, *(np.array(c) for c in zip(*want))).tolist() == root


def test_chains_over_tiles_and_crowds(spark, monkeypatch):
    """Long chains over many tiles, many ends at a place, places along a tile's side, batches merged early."""
    rnd = random.Random(13)
    wide = N.TILE * 0.01
    side = (np.arange(-40, 40) - N.SHIFT) * wide  # where tiles meet
    paths = [(k, side[k] + rnd.uniform(-0.012, 0.012), 0.0, side[k + 1] + rnd.uniform(-0.012, 0.012), rnd.uniform(-0.012, 0.012)) for k in range(79)]
    paths += [(100 + k, 7.0, 7.0, 9.0 + 0.008 * k, 9.0) for k in range(60)]  # one place, and a row of places that hang together
    paths += [(200 + k, 50.0 + k, 50.0, None, None) for k in range(5)] + [(300, None, None, None, None), (301, 50.0, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame([(h, *(None if v is None else float(v) for v in p)) for h, *p in paths], "handle long, ax double, ay double, bx double, b_y double")
    points = [(2 * h + s, *p) for h, ax, ay, bx, b_y in paths for s, p in ((0, (ax, ay)), (1, (bx, b_y))) if p[0] is not None]
    near = [(i, j) for i in range(len(points)) for j in range(i) if math.dist(points[i][1:], points[j][1:]) <= 0.01]
    node = components(len(points), near)
    one = {p[0]: k for k, p in enumerate(points)}
    own = [(one[2 * h], one[2 * h + 1]) for h, *_ in paths if 2 * h in one and 2 * h + 1 in one]
    chain = components(len(points), near + own)
    for rows in (S.TASK_ROWS, 25):
        monkeypatch.setattr(S, "TASK_ROWS", rows)
        assert {r.id: r.node for r in N.clustered_ends(df, 0.01).collect()} == {p[0]: points[node[k]][0] for k, p in enumerate(points)}
        got = {r.handle: r.chain for r in N.path_chains(df, 0.01).collect()}
        assert got == {p[0] // 2: points[chain[k]][0] // 2 for k, p in enumerate(points)}


def test_paths_that_meet_none_are_not_checkpointed(spark, monkeypatch):
    held = []
    real = graph.checkpointed

    def watched(df):
        out = real(df)
        held.append(out.count())
        return out

    for module in (graph, N):
        monkeypatch.setattr(module, "checkpointed", watched)
    paths = spark.range(500).select(F.col("id").alias("handle"), (F.col("id") * 5.0).alias("ax"), F.lit(0.0).alias("ay"), (F.col("id") * 5.0 + F.when(F.col("id") == 7, 5.0).otherwise(2.0)).alias("bx"), F.lit(0.0).alias("b_y"))
    assert N.clustered_ends(paths, 0.01).groupBy("node").count().where("count > 1").count() == 1
    assert sorted(r.n for r in N.path_chains(paths, 0.01).groupBy("chain").agg(F.count("*").alias("n")).where("n > 1").collect()) == [2]
    assert 0 < sum(held) < 20


def test_rounds_leave_no_files(spark):
    folder = lambda: spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    graph.linked(edges).count()
    before = set(os.listdir(folder()))
    assert {r.component for r in graph.linked(edges).collect()} == {0}
    assert len(set(os.listdir(folder())) - before) <= 2  # what is settled, and the last round
