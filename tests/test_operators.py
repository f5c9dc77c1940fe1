import pytest
from pyspark.sql import functions as F

from planline.errors import Refusal
from planline.operators import aggregates as A
from planline.operators import filters as O
from planline.operators import graph as GR
from planline.operators import text as T
from planline.operators import windows as W
from planline.plans.recipes import Recipe, default_registry
from planline.sources import dxf
from planline.sources.tables import read_entities, write_entities
from planline.streaming import arrivals


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.0), ("b", 2.0), ("c", None)], "layer string, length double")
    r = {x.layer: x for x in A.measure(df, ["layer"], "length").collect()}
    assert (r["a"].matched, r["a"].measured, r["a"].total_for_all_matched) == (2, 1, None)
    assert (r["b"].zeros, r["b"].total_for_all_matched) == (1, 2.0)
    assert r["c"].sum_measured_only is None


def test_mode_takes_the_least_of_a_tie(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 2.001), ("a", 1.0), ("a", None)], "g string, v double")
    r = A.mode_binned(df, ["g"], "v").first()
    assert (r.mode, r.mode_count, r.ties) == (1.0, 2, 2)


def test_empty_filter_is_refused(spark):
    df = spark.createDataFrame([(1, "A")], "handle int, layer string")
    with pytest.raises(Refusal):
        O.query_entities(df, layer="")


def test_no_outliers_without_spread(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4, "g string, v double")
    assert W.outliers(df, ["g"], "v", 0.0).count() == 0


@pytest.mark.parametrize("edges,want", [([(1, 2), (2, 3), (5, 6)], {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}), ([(k, k + 1) for k in range(1, 30)], {k: 1 for k in range(1, 31)} | {9: 1})])
def test_components(spark, edges, want):
    nodes = spark.createDataFrame([(k,) for k in want], "node long")
    got = GR.connected_components(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_printed_values(spark):
    rows = [("area 1,234.50 m", 1234.5, 2), ("none", None, None), (None, None, None), ("-7", -7.0, 0), ("12,3", 12.0, 0)]
    df = spark.createDataFrame(rows, "t string, v double, d long")
    for r in df.select("*", T.printed_value(F.col("t")).alias("p")).collect():
        assert (r.p.value, r.p.decimals) == (r.v, r.d)


def test_revision(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    b = spark.createDataFrame([("y", 2.5), ("z", None), ("w", 1.0)], "k string, v double")
    r = {x.k: x.status for x in GR.revision(a, b, ["k"], "v", 1e-6).collect()}
    assert r == {"x": "removed", "y": "changed", "z": "same", "w": "added"}


def test_recipes(spark):
    df = spark.createDataFrame([(k, "a", float(k if k < 9 else 100), 1.0, 1.0) for k in range(10)], "handle int, layer string, area double, w double, h double")
    registry = default_registry()
    assert [r.handle for r in registry.run("outliers", df, z=2).collect()] == [9]
    left, right = ("outliers", {"z": 0.1}), ("outliers", {"z": 2})
    assert registry.combine(df, left, right, "difference").count() == registry.run("outliers", df, z=0.1).count() - 1
    for bad in (lambda: registry.run("nothing", df), lambda: registry.run("outliers", df, zz=1), lambda: registry.run("outliers", df, z="x"), lambda: registry.combine(df, left, ("size_module", {}), "union")):
        with pytest.raises(Refusal):
            bad()
    with pytest.raises(Refusal):
        registry.register(Recipe("outliers", None))


DXF = """0
SECTION
2
BLOCKS
0
BLOCK
2
DOOR
0
LINE
5
B1
8
0
10
0
20
0
11
3
21
4
0
ENDBLK
0
ENDSEC
0
SECTION
2
ENTITIES
0
LWPOLYLINE
5
A1
8
PARCELS
70
1
10
0
20
0
10
4
20
0
10
4
20
3
10
0
20
3
0
TEXT
5
A2
8
LABELS
10
1
20
2
1
449.5
0
CIRCLE
5
A3
8
TREES
10
5
20
5
40
2
0
ENDSEC
0
EOF
"""


def test_dxf(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF)
    rows = {r.handle: r for r in dxf.read_dxf(spark, str(tmp_path)).collect()}
    assert rows["A1"].area == 12 and rows["A1"].length == 14 and rows["A1"].ring_status == "complete"
    assert rows["A2"].text == "449.5" and rows["A2"].anchor_point.x == 1 and rows["A2"].length is None
    assert rows["A3"].minx == 3 and rows["B1"].layout == "[block] DOOR" and rows["B1"].length == 5
    assert len({r.drawing_id for r in rows.values()}) == 1
    assert dxf.truncated(DXF) is None and dxf.truncated(DXF[:80])


def test_drawn_table(spark, tmp_path):
    (tmp_path / "a.dxf").write_text("0\nACAD_TABLE\n91\n2\n92\n2\n302\na\n302\nb\n302\nc\n302\nd\n0\nEOF\n")
    cells = dxf.read_parts(spark, str(tmp_path), "tables", 17).select("number", "row", "column", "text")
    assert sorted(map(tuple, cells.collect())) == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "c"), (0, 1, 1, "d")]


def test_partitions_are_replaced(spark, tmp_path):
    ddl = "drawing_id string, layout string, layer string, type string, handle string"
    path = str(tmp_path / "entities")
    write_entities(spark.createDataFrame([("d1", "M", "A", "LINE", "1"), ("d2", "M", "A", "LINE", "1")], ddl), path)
    write_entities(spark.createDataFrame([("d1", "M", "B", "ARC", "7")], ddl), path)
    assert sorted((r.drawing_id, r.handle) for r in read_entities(spark, path).collect()) == [("d1", "7"), ("d2", "1")]


def test_stream_is_idempotent(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.unionByName(source).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = arrivals.idempotent(arrivals.events(spark, str(tmp_path / "in"), source.schema), ["event_id"], "365 days")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        arrivals.run_to_end(stream, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(out).count() == source.count()
