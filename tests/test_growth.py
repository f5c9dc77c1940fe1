"""Work that must not grow faster than its input: expressions worked out once, joins dealt by key."""

import re

import pytest
from pyspark.sql import functions as F

from planline.functions import geometry as G
from planline.operators import blocks, duplicates, graph, network
from planline.operators import spatial as S

def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans that checkpoints ran, as planned from the files' sizes."""
    seen = []
    real = graph.checkpointed

    def watched(df):
        seen.append(planned(df))
        return real(df)

    for module in (graph, network, blocks, duplicates):
        monkeypatch.setattr(module, "checkpointed", watched)
    return seen


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def squares(spark):
    corner = lambda x, y: F.struct((F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"))
    at = spark.range(6).select(F.col("id").alias("handle"), (F.col("id") * 4.0).alias("x"), F.lit(0.0).alias("y"))
    box = [F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 3).alias("maxx"), (F.col("y") + 3).alias("maxy")]
    return at.select("handle", F.lit("a").alias("layer"), "x", "y", *box, F.array(*[corner(*c) for c in ((0, 0), (3, 0), (3, 3), (0, 3))]).alias("ring"))


def test_the_steps_of_a_shape_key_are_worked_out_once(squares):
    assert optimized(squares.select(G.shape_key(F.col("ring")))).lower().count("atan2") <= 2


def test_shape_keys_of_one_file_are_many_tasks(spark, squares):
    one = squares.coalesce(1)
    assert "REPARTITION_BY_COL" in planned(duplicates.modal_edges(one))
    assert [(r.times, r.n) for r in duplicates.modal_edges(one).collect()] == [(6, 6)]


def test_ring_distances_are_worked_out_once_and_outside_the_join(spark, squares):
    near = S.rings_near(squares, 8.0, 1.5)
    joins = [line for line in optimized(near).splitlines() if line.lstrip(" :+-").startswith("Join")]
    assert joins and not any("hypot" in line.lower() for line in joins)
    assert optimized(near).lower().count("hypot") == 2  # a's corners to b, b's to a
    got = {(r.a_handle, r.b_handle): r.distance for r in near.collect()}
    assert got == {(k, k + 1): 1.0 for k in range(5)}


def test_spatial_joins_are_not_broadcast(spark, squares):
    points = squares.select("handle", "x", "y")
    for df in (S.within_radius(points, points, 4.0), S.points_in_rings(points, squares, 8.0), S.box_pairs(squares, 8.0, 1.0), S.rings_near(squares, 8.0, 1.5)):
        assert "Broadcast" not in planned(df)


def test_components_and_reach_are_not_broadcast(spark, plans):
    nodes = spark.range(8).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    assert graph.reachable(spark, edges, nodes.where("node = 0")).count() == 4
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_wide_cells_find_the_same_pairs_by_fewer_rows(spark):
    points = spark.range(400).select(F.col("id").alias("handle"), (F.pmod(F.hash("id"), F.lit(1000)) / 100 - 5).alias("x"), (F.pmod(F.hash("id", F.lit(1)), F.lit(1000)) / 100 - 5).alias("y"))
    pairs = lambda cell: {(r.c_handle, r.o_handle) for r in S.within_radius(points, points, 0.5, cell=cell).collect()}
    assert pairs(2.0) == pairs(None) == pairs(0.5) and len(pairs(2.0)) > 400


def test_inserts_are_not_broadcast(spark, plans):
    inserts = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "container long, block long")
    times = blocks.multiplicity(inserts, spark.createDataFrame([(1,)], "root long"), 10)
    assert {r.block: int(r.times) for r in times.collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    assert plans and not any("Broadcast" in p for p in plans)


def test_ends_are_not_broadcast(spark, plans):
    paths = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0), (2, 5.001, 0.0, 9.0, 0.0)], "handle long, ax double, ay double, bx double, b_y double")
    nodes = network.node_degrees(network.clustered_ends(paths, 0.01))
    assert {(r.node, r.degree) for r in nodes.collect()} == {(2, 1), (3, 2), (5, 1)}
    assert plans and not any("Broadcast" in p for p in [*plans, planned(nodes)])


def tasks(df):
    return {int(n) for n in re.findall(r"hashpartitioning\(level.*?, (\d+)\)", planned(df))}


def most_in_a_task(df):
    return df.select(F.spark_partition_id().alias("task")).groupBy("task").count().agg(F.max("count")).first()[0]


def test_points_meet_boxes_in_as_many_tasks_as_their_rows_need(spark, squares, monkeypatch):
    at = lambda k, wide: F.pmod(F.hash("id", F.lit(k)), F.lit(wide)) / 100
    # nine tenths of the points lie in the cell of the first two squares
    points = spark.range(400).select(F.col("id").alias("handle"), F.when(F.col("id") % 10 == 0, at(0, 2400)).otherwise(at(0, 800)).alias("x"), at(1, 800).alias("y"))
    ask = lambda: S.points_in_boxes(points, squares, 8.0)
    want = sorted((r.p_handle, r.r_handle) for r in ask().collect())
    assert tasks(ask()) == {4} and len(want) > 80
    monkeypatch.setattr(S, "TASK_ROWS", 40)
    assert sorted((r.p_handle, r.r_handle) for r in ask().collect()) == want
    assert min(tasks(ask())) >= 10 and most_in_a_task(ask()) < len(want) / 2


def test_boxes_meet_in_as_many_tasks_as_their_rows_need(spark, squares, monkeypatch):
    boxes = squares.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("handle", F.col("handle") * 10 + F.col("copy")).drop("copy")
    ask = lambda: S.box_pairs(boxes, 8.0, 1.0)
    want = sorted((r.a_handle, r.b_handle) for r in ask().collect())
    assert tasks(ask()) == {4} and len(want) == 6 * 45 + 5 * 100
    monkeypatch.setattr(S, "TASK_ROWS", 15)
    assert sorted((r.a_handle, r.b_handle) for r in ask().collect()) == want
    assert min(tasks(ask())) >= 10 and most_in_a_task(ask()) < len(want) / 2


def test_boxes_of_two_tables_meet_no_box_of_their_own(spark, squares, monkeypatch):
    """Pairs that the join by cell looks at: 300 boxes in one cell against 6, not against each other."""
    crowd = spark.range(300).select(F.col("id").alias("handle"), (F.col("id") % 20).cast("double").alias("minx"), F.lit(1.0).alias("miny"))
    crowd = crowd.select("*", (F.col("minx") + 0.5).alias("maxx"), F.lit(1.5).alias("maxy"))
    far = squares.withColumns({"handle": F.col("handle") + 100, "minx": F.col("minx") + 1e6, "maxx": F.col("maxx") + 1e6})
    looked = []
    real = S._meet

    def watched(*sides, **more):
        near = real(*sides, **more)
        looked.append(near.count())
        return near

    monkeypatch.setattr(S, "_meet", watched)
    fields = ("handle", "minx", "miny", "maxx", "maxy")
    ask = lambda: sorted((r.a_handle, r.b_handle) for r in S.box_matches(crowd, squares.select(*fields).union(far.select(*fields)), 64.0, 0.1).collect())
    want = sorted((k, j) for k in range(300) for j in range(6) if k % 20 - 0.1 <= 4 * j + 3.1 and 4 * j - 0.1 <= k % 20 + 0.6)
    assert ask() == want and looked[-1] <= 4 * 300 * 6
    monkeypatch.setattr(S, "TASK_ROWS", 40)  # full cells of either side are dealt
    assert ask() == want
