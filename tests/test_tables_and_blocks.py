"""Versions and commits of entity tables, circles of inserts, world placement, hierarchy and widths."""

import pytest
from pyspark.sql import functions as F

from planline.errors import Refusal
from planline.operators import blocks as B
from planline.operators import graph, network
from planline.sources import tables as T

ENTITY = "drawing_id string, layout string, layer string, type string, handle string"


def rows(spark, *keys):
    return spark.createDataFrame([(d, "M", "A", "LINE", h) for d, h in keys], ENTITY)


def seen(df):
    return sorted((r.drawing_id, r.handle) for r in df.collect())


def test_a_reader_sees_one_version_and_stale_files_are_swept(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    T.write_entities(rows(spark, ("d1", "1"), ("d1", "2"), ("d2", "1")), path, {"d1": "first"})
    before = T.read_entities(spark, path)
    # files of a write that has not committed are not seen
    rows(spark, ("d1", "8"), ("d3", "8")).write.partitionBy("drawing_id").parquet(f"{path}/rows/version=lost")
    assert seen(T.read_entities(spark, path)) == [("d1", "1"), ("d1", "2"), ("d2", "1")]
    T.write_entities(rows(spark, ("d1", "7")), path)
    assert seen(before) == [("d1", "1"), ("d1", "2"), ("d2", "1")]
    assert seen(T.read_entities(spark, path)) == [("d1", "7"), ("d2", "1")] and seen(T.read_entities(spark, path, "d1")) == [("d1", "7")]
    assert T.sweep(spark, path, 0) == 0 and T.sweep(spark, path, 1) == 1 and T.sweep(spark, path, 1) == 0
    assert seen(T.read_entities(spark, path)) == [("d1", "7"), ("d2", "1")]
    T.drop_drawings(spark, path, ["d1"])
    assert seen(T.read_entities(spark, path)) == [("d2", "1")]
    assert [(r.drawing_id, r.entities, r.commit) for r in T.catalog(spark, path).collect()] == [("d2", 1, 0)]
    with pytest.raises(FileNotFoundError):
        T.read_entities(spark, path, "d1")


def test_commits_never_replace_one_another(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    change = {"drawing_id": "d", "version": "v", "entities": 1, "catalog": None}
    assert [T._commit(spark, path, [change | {"version": str(k)}]) for k in range(3)] == [0, 1, 2]
    assert T.catalog(spark, path).first().version == "2"


def inserts(spark, pairs):
    return spark.createDataFrame([(a, b, 0.0, 0.0, 0.0, 1.0, 1.0) for a, b in pairs], "container string, block string, x double, y double, angle double, sx double, sy double")


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


@pytest.mark.parametrize("f", [B.multiplicity, B.placements])
def test_a_circle_is_refused_in_few_rounds_and_one_beside_is_not(spark, f):
    pair = inserts(spark, [("m", "a"), ("a", "b"), ("b", "a"), ("x", "y")])
    with pytest.raises(Refusal) as refused:
        f(pair, roots(spark, "m"), 10_000)
    assert refused.value.code == "circular_inserts"
    chain = [(f"c{k}", f"c{k + 1}") for k in range(12)]
    assert f(inserts(spark, [("c0", "c1"), *chain, ("p", "q"), ("q", "p")]), roots(spark, "c0"), 10_000).count() >= 12


def test_more_copies_than_can_be_said_are_refused(spark):
    with pytest.raises(Refusal) as refused:
        refuse_big(spark)
    assert refused.value.code == "too_many_copies"


def refuse_big(spark):
    """Six levels of ten million inserts each, counted beforehand."""
    real = B.checkpointed
    edges = spark.createDataFrame([(f"c{k}", f"c{k + 1}", 10_000_000) for k in range(6)], "container string, block string, n long")
    first = []

    def counted(df):
        first.append(1)
        return edges if len(first) == 1 else real(df)

    B.checkpointed = counted
    try:
        return B.multiplicity(inserts(spark, [("c0", "c1")]), roots(spark, "c0"), 10)
    finally:
        B.checkpointed = real


def test_levels_hold_every_row_once(spark):
    levels = graph.Levels()
    for k in range(20):
        levels.add(spark.range(k, k + 1))
    assert sorted(r.id for r in levels.all().collect()) == list(range(20)) and len(levels._parts) < 8


def test_world_placement(spark):
    moved = spark.createDataFrame([("Model", "same", 0.0, 0.0), ("Model", "moved", 5.0, 0.0), ("Model", "both", 0.0, 0.0), ("moved", "both", 0.0, 0.0), ("same", "inner", 0.0, 0.0)], "container string, block string, x double, y double")
    placed = B.placements(moved.select("*", F.lit(0.0).alias("angle"), F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy")), roots(spark, "Model"), 10)
    data = [("Model", False, 99.0), ("Sheet", False, 1.0), ("same", True, 1.0), ("same", True, 99.0), ("inner", True, 1.0), ("moved", True, 1.0), ("both", True, 1.0), ("nowhere", True, 1.0), ("same", True, None)]
    df = spark.createDataFrame([(k, c, b, x, 1.0) for k, (c, b, x) in enumerate(data)], "handle int, container string, in_block boolean, x double, y double")
    got = B.world_placed(df, placed, (0.0, 0.0, 10.0, 10.0))
    assert {r.handle: (r.space, r.world) for r in got.collect()} == {
        0: ("layout", True), 1: ("layout", True), 2: ("identity", True), 3: ("identity", False), 4: ("identity", True), 5: ("placed", False), 6: ("ambiguous", False), 7: ("unplaced", False), 8: ("identity", False),
    }
    assert sorted(r.handle for r in B.in_scope(got, "Model").collect()) == [0, 2, 4] and [r.handle for r in B.in_scope(got, "Sheet").collect()] == [1]
    assert not B.world_placed(df, placed, None).where("in_block and world").count()


def test_hierarchy_of_a_grid_and_of_nothing(spark):
    lines = [((x, y), (x + 10, y)) for x in (0, 10, 20) for y in (0, 10)] + [((x, 0), (x, 10)) for x in (0, 10, 20, 30)]
    ddl = "handle long, ax double, ay double, bx double, b_y double, length double"
    df = spark.createDataFrame([(k, *map(float, a), *map(float, b), None if k == 0 else 10.0) for k, (a, b) in enumerate(lines)], ddl)
    got = network.road_hierarchy(df, 0.1).first()
    # 10 lines; the four corners hold two ends, the others three: between those run (10, 20) twice and two rungs
    assert (got.spacings, got.total, got.median, got.not_between, got.unmeasured, got.dead_ends) == (4, 40.0, 10.0, 6, 0, 0)
    none = network.road_hierarchy(df.limit(1), 0.1).first()
    assert (none.spacings, none.median, none.not_between, none.dead_ends) == (0, None, 1, 2)


def test_widths_of_strips(spark):
    df = spark.createDataFrame([("a", 200.0, 240.0 - 36), ("a", 400.0, 204.0), ("a", None, 4.0), ("b", 0.0, 4.0)], "layer string, area double, perimeter double")
    got = network.corridor_widths(df, ["layer"]).collect()
    assert len(got) == 1 and got[0].rings == 2 and abs(got[0].most - 800 / 204) < 1e-9 and abs(got[0].median_length - 102) < 1e-9
